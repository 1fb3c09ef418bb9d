"""Exact BPE encoding and decoding of whole texts by speculation and verification.

1. Speculate: a trie of all tokens gives, for every position of every word at once, the longest token that begins there; each word takes the
   longest, goes on behind it, and so on. No merge is made.
2. Verify: a row of tokens is what merging by rank gives exactly when each token is what merging makes of its own symbols, and each adjacent pair
   stays apart when merged alone. The first is a flag per token, worked out once for the vocabulary. The second undoes the merges of both tokens,
   the later one first, and asks at each step whether the two symbols at the border had a merge that would have come before (`apart`); all distinct
   adjacent pairs of a batch are tested together.
3. Only words with a failing token or pair are merged exactly: short ones all together, the lowest rank of each word in every round, long ones one by
   one with a heap.

Texts are cut into words by the tokenizer's own normaliser and pre-tokenizer; each distinct word is encoded once for as long as a worker has room
(packing.WordTokenizer). Vocabularies must drop white space, build every token by one merge at most, and merge only what lower ranks have made; others
are refused. Decoding is the library's for files without a decoder: the tokens' own strings, joined by a space.

Defined results: null text: as empty, no ids, decoded to the empty string. Special tokens' strings in a text are those tokens. Repeated rows: each is
encoded. Null ids stay null. Ids that the vocabulary lacks are left out when decoding, as null is; a null list decodes to null. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .packing import WordTokenizer

NONE = np.int64(1) << 40  # a rank that no merge has
SHORT = 128  # symbols up to which failing words are merged together
LOT = 2000  # words that are normalised in one call
TOKENS = 1 << 17  # tokens that are spelled out at a time


class Merges:
    """The vocabulary as arrays: parts and rank of every token, the trie, and which tokens are what merging makes of their own symbols."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain BPE vocabulary is needed")
        self.vocabulary = vocabulary = model["vocab"]
        self.size = size = max(vocabulary.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or len(made) and (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any():
            raise ValueError("each token must have one merge, of parts that lower ranks have made")
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[made], self.right[made] = left, right
        key = left * size + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.sound = self._sound(left, right)
        self._trie(list(zip(left.tolist(), right.tolist(), made.tolist(), strict=True)))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NONE if there is none."""
        key = a * self.size + b
        if not len(self.keys):
            return np.full(len(key), NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def apart(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether merging the symbols of each pair of tokens never crosses their border; joined: but for the last merge, of the two themselves."""
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(x), NONE), np.full(len(x), NONE)  # ranks at which the border's symbols are taken into larger ones
        ok, live, first = np.ones(len(x), bool), np.arange(len(x)), joined
        while len(live):
            p, q = x[live], y[live]
            if not first:
                r = self.rank_of(p, q)
                # of equal ranks the one further left is merged first: x's own merge before the border's, the border's before y's
                crossed = (r < NONE) & (r < until_x[live]) & (r <= until_y[live])
                ok[live[crossed]] = False
                live = live[~crossed]
                p, q = p[~crossed], q[~crossed]
            first = False
            rx, ry = self.rank[p], self.rank[q]
            undo_x = rx > ry  # equal ranks: the right one was merged last
            undo_y = ~undo_x & (ry >= 0)
            i, j = live[undo_x], live[undo_y]
            until_x[i], x[i] = rx[undo_x], self.right[p[undo_x]]
            until_y[j], y[j] = ry[undo_y], self.left[q[undo_y]]
            live = live[undo_x | undo_y]
        return ok

    def _sound(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sound = np.ones(self.size, bool)
        own = self.apart(left, right, joined=True)
        for a, b, t, ok in zip(left.tolist(), right.tolist(), self.made.tolist(), own.tolist(), strict=True):
            sound[t] = ok and sound[a] and sound[b]
        return sound

    def _trie(self, merges: list[tuple[int, int, int]]) -> None:
        symbols = {t: (t,) for t in self.vocabulary.values()}
        for a, b, t in merges:
            symbols[t] = symbols[a] + symbols[b]
        child: dict[int, int] = {}
        token = [-1]
        for t, path in symbols.items():
            at = 0
            for s in path:
                nxt = child.setdefault(at * self.size + s, len(token))
                if nxt == len(token):
                    token.append(-1)
                at = nxt
            token[at] = t
        self.edges = np.array(sorted(child), np.int64)
        self.ends = np.array([child[k] for k in self.edges.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        # the states behind two symbols, as a table: most steps are the first two
        self.first = np.unique(np.array([p[0] for p in symbols.values()] + [s for p in symbols.values() for s in p[1:2]], np.int64))
        self.place = np.full(self.size, -1, np.int64)
        self.place[self.first] = np.arange(len(self.first))
        self.two = np.full((len(self.first), len(self.first)), -1, np.int32)
        for p in {p[:2] for p in symbols.values() if len(p) > 1}:
            self.two[self.place[p[0]], self.place[p[1]]] = child[child[p[0]] * self.size + p[1]]

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the longest token that begins there, and its number of symbols."""
        n = len(symbols)
        token, size = symbols.astype(np.int64), np.ones(n, np.int64)
        if n < 2:
            return token, size
        i, j = self.place[symbols[:-1]], self.place[symbols[1:]]
        state = np.where((i >= 0) & (j >= 0), self.two[i, j], -1).astype(np.int64)
        at, k = np.flatnonzero(state >= 0), 2
        state = state[at]
        t = self.token[state]
        token[at[t >= 0]], size[at[t >= 0]] = t[t >= 0], 2
        go = at + 2 < n
        at, state = at[go], state[go]
        while len(at):
            key = state * self.size + symbols[at + k]
            e = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[e] == key
            at, state = at[there], self.ends[e[there]]
            k += 1
            t = self.token[state]
            token[at[t >= 0]], size[at[t >= 0]] = t[t >= 0], k
            go = at + k < n
            at, state = at[go], state[go]
        return token, size

    def greedy(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from left to right within each word: the tokens of all words in a row, and where each word's begin."""
        token, size = self.longest(symbols)
        first = np.zeros(len(symbols), bool)
        at, end = begin[:-1], begin[1:]
        at, end = at[at < end], end[at < end]
        while len(at) > 32:
            first[at] = True
            at = at + size[at]
            at, end = at[at < end], end[at < end]
        if len(at):  # a few long words
            steps = size.tolist() if len(at) else []
            for i, e in zip(at.tolist(), end.tolist(), strict=True):
                while i < e:
                    first[i] = True
                    i += steps[i]
        count = np.concatenate([[0], np.cumsum(first)])
        return token[first], count[begin]

    def exact(self, symbols: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """The tokens of each word by merging: always the lowest rank, the leftmost of equals."""
        size = np.diff(begin)
        out: list = [None] * len(size)
        for w in np.flatnonzero(size > SHORT).tolist():
            out[w] = self._heap(symbols[begin[w]:begin[w + 1]].tolist())
        words = np.flatnonzero(size <= SHORT)
        now = np.concatenate([symbols[begin[w]:begin[w + 1]] for w in words]) if len(words) else np.zeros(0, np.int64)
        of = np.repeat(words, size[words])
        while len(words):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            r = np.full(len(now), NONE)
            r[:-1] = np.where(of[1:] == of[:-1], self.rank_of(now[:-1], now[1:]), NONE)
            low = np.minimum.reduceat(r, starts)
            done = low == NONE
            bounds = np.append(starts, len(now))
            for k in np.flatnonzero(done).tolist():
                out[words[k]] = now[bounds[k]:bounds[k + 1]]
            sizes = np.diff(bounds)
            at = np.flatnonzero((r == np.repeat(low, sizes)) & (r < NONE))
            at = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])] if len(at) else at  # the leftmost of each word
            now[at] = self.made[r[at]]
            keep = ~np.repeat(done, sizes)
            keep[at + 1] = False
            now, of, words = now[keep], of[keep], words[~done]
        return out

    def _heap(self, s: list[int]) -> np.ndarray:
        n = len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.rank_of(np.array(s[:-1]), np.array(s[1:]))
        heap = [(int(r), i, s[i], s[i + 1]) for i, r in enumerate(first.tolist()) if r < NONE]
        heapq.heapify(heap)
        ranks = {}

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n:
                key = (s[i], s[j])
                if key not in ranks:
                    ranks[key] = int(self.rank_of(np.array([s[i]]), np.array([s[j]]))[0])
                if ranks[key] < NONE:
                    heapq.heappush(heap, (ranks[key], i, *key))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # one of the two has been merged
            s[i], s[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([t for t in s if t >= 0], np.int64)

    def encode(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The tokens of all words in a row, where each word's begin, and how many words failed the tests."""
        tokens, at = self.greedy(symbols, begin)
        n = len(begin) - 1
        of = np.repeat(np.arange(n), np.diff(at))
        bad = np.zeros(n, bool)
        bad[of[~self.sound[tokens]]] = True
        inner = np.flatnonzero(of[1:] == of[:-1])
        if len(inner):
            pair, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
            bad[of[inner[~self.apart(pair // self.size, pair % self.size)[back]]]] = True
        failed = np.flatnonzero(bad)
        if not len(failed):
            return tokens, at, 0
        size = np.diff(begin)[failed]
        own = np.concatenate([[0], np.cumsum(size)])
        flat = symbols[np.repeat(begin[failed] - own[:-1], size) + np.arange(own[-1])]
        merged = self.exact(flat, own)
        count = np.diff(at)
        count[failed] = [len(m) for m in merged]
        out = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(out[-1], np.int64)
        good = ~bad[of]
        ids[np.repeat(~bad, count)] = tokens[good]
        ids[np.repeat(bad, count)] = np.concatenate(merged)
        return ids, out, len(failed)


class SpeculativeTokenizer(WordTokenizer):
    """WordTokenizer's texts, with words encoded by Merges instead of the library; its normaliser and pre-tokenizer cut the words."""

    most_known = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("added tokens must be matched as they are, without a decoder or post-processor")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        vocabulary = self.merges.vocabulary
        self.inner, self.last = np.full(0x400, -1, np.int64), np.full(0x400, -1, np.int64)
        for t, i in vocabulary.items():
            if len(t) == 1 and ord(t) < 0x400:
                self.inner[ord(t)] = i
            if self.suffix and len(t) == 1 + len(self.suffix) and t.endswith(self.suffix) and ord(t[0]) < 0x400:
                self.last[ord(t[0])] = i
        if not self.suffix:
            self.last = self.inner
        super().__init__(path)
        if self._pieces(["a", "b"])[1] != [1, 1] or self.plain.pre_tokenizer.pre_tokenize_str("a b")[1][0] != "b":
            raise ValueError("the tokenizer must drop white space")

    def _cut(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.plain.pre_tokenizer.pre_tokenize_str(text)

    def _pieces(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of the words in a row, and how many each has."""
        pieces, counts = [], []
        normal = self.plain.normalizer.normalize_str if self.plain.normalizer else str
        for i in range(0, len(words), LOT):
            lot = words[i:i + LOT]
            row = " ".join(lot)
            # a word with white space in it, or without anything else, makes another number of parts
            own = normal(row).split(" ") if all(lot) and len(row.split()) == len(lot) else []
            if len(own) == len(lot):
                begin = np.cumsum([0] + [len(w) + 1 for w in own])
                got = self._cut(" ".join(own))
                at = np.searchsorted(begin, [x[1][0] for x in got], "right") - 1
                pieces += [x[0] for x in got]
                counts += np.bincount(at.astype(np.int64), minlength=len(lot)).tolist()
            else:
                for w in lot:
                    got = self._cut(normal(w))
                    pieces += [x[0] for x in got]
                    counts.append(len(got))
        return pieces, counts

    def cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self._pieces(words)
        flat = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        symbols = self.inner[flat]
        symbols[begin[1:] - 1] = self.last[flat[begin[1:] - 1]]
        if len(symbols) and symbols.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        ids, at, _ = self.merges.encode(symbols, begin)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids.astype(np.uint32), at[ends]

    def one(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        return np.concatenate([np.array([self.added[p]], np.uint32) if k % 2 else self.cores([p])[0] for k, p in enumerate(parts) if p] or [np.zeros(0, np.uint32)])


class Speller:
    """Token strings and a space behind each, as bytes."""

    def __init__(self, vocabulary: dict[str, int], added: dict[str, int]):
        table = [b""] * (max([*vocabulary.values(), *added.values()], default=-1) + 1)
        for t, i in {**vocabulary, **added}.items():
            table[i] = t.encode() + b" "
        self.size = np.array([len(t) for t in table], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        out = []
        ids = ids.astype(np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        for i in range(0, len(ids), TOKENS):
            x = ids[i:i + TOKENS]
            size = self.size[x]
            end = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.at[x] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out)[:-1]


_tokenizers: dict[str, tuple[SpeculativeTokenizer, Speller]] = {}


def _tokenizer(path: str) -> tuple[SpeculativeTokenizer, Speller]:
    if path not in _tokenizers:
        t = SpeculativeTokenizer(path)
        _tokenizers[path] = t, Speller(t.merges.vocabulary, t.added)
    return _tokenizers[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""

    def run(batches):
        t, speller = _tokenizer(tokenizer)
        for batch in sliced(batches, 1 << 19):
            ids = list(t.texts(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
            decoded = pa.array([speller.spell(x).decode() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.select(f'`{id_col}`').dtypes[0][1]}, ids array<int>, decoded string")


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded string of every row's array of ids."""

    def run(batches):
        speller = _tokenizer(tokenizer)[1]
        for batch in sliced(batches, 1 << 20):
            decoded = [None if x is None else speller.spell(np.array([i for i in x if i is not None], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<long>").alias("ids")).mapInArrow(run, f"doc_id {rows.select(f'`{id_col}`').dtypes[0][1]}, decoded string")
