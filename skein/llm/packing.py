"""Best-fit packing of token pieces by length patterns and non-negative least squares (Krell et al. 2021, NNLSHP).

1. Each whole text becomes token ids and a final 0; only documents longer than `most` are cut, into pieces of `most`.
2. The histogram of piece lengths (at most `most` rows, whatever the input) comes to the driver. Patterns of one to three lengths that
   fill a sequence exactly are enumerated, most likely first; non-negative least squares (multiplicative updates) fits how often
   each is used to the histogram; counts are rounded systematically and held to what is there; the rest is packed best fit, longest
   first, over the histogram. The plan is a list of runs: ranks r0 to r1 among the pieces of one length go to consecutive
   sequences from `base` on, at one offset. Its length depends on `most` and the patterns, and is bounded by those, not by the input.
3. Pieces are ranked within their length (common.ranked, no window over a length), and each finds its run by binary search.

Defined results: null text: as empty, one piece of the single id 0. Repeated rows: each is packed. Null ids stay null. Empty
table: no rows. Special tokens' strings in a text are those tokens, as the tokenizer has it. Other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ranked, sliced

PATTERNS = 8192
KNOWN_WORDS = 500_000  # of a worker; beyond, it begins anew
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens

class WordTokenizer:
    """Token ids of whole texts, each distinct word encoded once for as long as KNOWN_WORDS have room.

    The tokenizer drops white space, lower-cases, splits letters from other signs and never merges across these bounds. So a text's ids are those
    of its white-space-separated words in a row, A-Z may be lower-cased before, and a comma or full stop after a letter is a token of its
    own. Words are encoded many at a time. Each run of letters or of other signs ends with a token that marks an end of word, so a lot of words
    of letters alone that has as many such tokens as words is cut at them. Other lots have a special token between their words, and
    a lot that has not as many of these as words is encoded word by word. Texts that hold a special token's string are encoded as they
    are, since such a string may run across these bounds.
    """

    most_known = KNOWN_WORDS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        vocabulary = self.plain.get_vocab()
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.mark = self.special[0] if self.special else None
        self.mark_id = vocabulary.get(self.mark, -1)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tail = {x: self.one(x) for x in ",."}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size, self.at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> np.ndarray:
        """The places of the words among those known."""
        if len(self.known) > self.most_known:
            self.forget()
        known = self.known
        before = len(known)
        out = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) > before:
            ids, begin = self.cores(list(known)[before:] if before else list(known))
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, np.diff(begin)])
            self.at = np.concatenate([[0], np.cumsum(self.size)])
        return out

    def one(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.one(w) for w in words]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)

    def _lots(self, words: list[str], step: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many each has. Words of letters alone stand first."""
        n = sum(w.isalpha() for w in words)
        cuts = sorted({*range(0, n, step), *range(n, len(words), step), len(words)})
        lots = [words[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        letters = [i < n for i in cuts[:-1]]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        got = self.plain.encode_batch_fast([" ".join(x) if a else self._marked(x) for x, a in zip(lots, letters, strict=True)], add_special_tokens=False)
        for own, alone, e in zip(lots, letters, got, strict=True):
            x = np.array(e.ids, np.uint32)
            if alone:
                ends = np.flatnonzero(self.ends_word[x]) + 1
                if len(ends) == len(own):
                    ids.append(x), sizes.append(np.diff(ends, prepend=0))
                    continue
                x = np.array(self.plain.encode(self._marked(own), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(x == self.mark_id)
            if len(ends) == len(own):
                ids.append(np.delete(x, ends)), sizes.append(np.diff(ends - np.arange(len(ends)), prepend=0))
            else:
                x, size = self._each(own)
                ids.append(x), sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int64)

    def _marked(self, words: list[str]) -> str:
        return "".join(f"{w} {self.mark} " for w in words) if self.mark else ""

    def cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space in a row, and where each word's begin (one more at the end)."""
        order = sorted(range(len(words)), key=lambda k: not words[k].isalpha())
        ids, sizes = self._lots([words[i] for i in order])
        at = np.concatenate([[0], np.cumsum(sizes)])
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        size = sizes[place]
        begin = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(at[place] - begin[:-1], size) + np.arange(begin[-1])], begin

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words whose A-Z are lower-cased, with commas and full stops after ASCII letters set apart first."""
        tail, cut = np.zeros(len(words), np.int64), list(words)
        for k, w in enumerate(words):
            if len(w) > 1 and w[-1] in ",." and w[-2].isascii() and w[-2].isalpha():
                tail[k] = 1 + (w[-1] == ".")
                cut[k] = w[:-1]
        core = self.learn(cut)
        ids, at, own = self.ids, self.at, self.size[core]
        extra = np.array([0, len(self.tail[","]), len(self.tail["."])])[tail]
        begin = np.concatenate([[0], np.cumsum(own + extra)])
        out = np.empty(begin[-1], np.uint32)
        out[np.repeat(begin[:-1], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)] = ids[np.repeat(at[core] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        for x, sign in ((1, ","), (2, ".")):
            for j, v in enumerate(self.tail[sign]):
                out[(begin[:-1] + own)[tail == x] + j] = v
        return out, begin

    def texts(self, column: pa.Array):
        """The ids of each text, in order."""
        column = pc.fill_null(column, "")
        whole = np.zeros(len(column), bool)
        for t in self.special:
            whole |= np.asarray(pc.match_substring(column, t, ignore_case=True))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(whole), "", column)))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists  # may hold empty words at the ends
        first = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        ids, begin = self.words(coded.dictionary.to_pylist())
        size = np.diff(begin)
        index = np.asarray(coded.indices)
        i, n = 0, len(first) - 1
        while i < n:  # some texts at a time bound the memory
            j = max(i + 1, int(np.searchsorted(first, first[i] + 200_000, "right")) - 1)
            w = index[first[i]:first[j]]
            count = size[w]
            at = np.zeros(len(w) + 1, np.int64)
            np.cumsum(count, out=at[1:])
            flat = ids[np.repeat(begin[w] - at[:-1], count) + np.arange(at[-1])] if at[-1] else np.zeros(0, np.uint32)
            for k in range(i, j):
                yield self.one(column[k].as_py()) if whole[k] else flat[at[first[k] - first[i]]:at[first[k + 1] - first[i]]]
            i = j


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, most: int) -> DataFrame:
    """Rows of PIECES: each document's ids and a final 0, cut only where longer than most."""

    def run(batches):
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordTokenizer(tokenizer)
        t = _tokenizers[tokenizer]
        for batch in sliced(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            zero = np.zeros(1, np.uint32)
            for doc, ids in zip(batch.column(0).to_pylist(), t.texts(batch.column(1)), strict=True):
                ids = np.concatenate([ids, zero]).astype("<u4")
                for k, a in enumerate(range(0, len(ids), most)):
                    one = ids[a:a + most]
                    for o, v in zip(out, (doc, k, a, len(one), zlib.crc32(one.tobytes())), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32() if i == 1 else pa.int64()) for i, o in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- plan

def patterns(h: np.ndarray, most: int, limit: int = PATTERNS) -> np.ndarray:
    """Up to `limit` sorted triples of lengths (0: none) that sum to most, of lengths that occur, the likeliest first."""
    a = np.arange(0, most // 3 + 1)
    rows = [np.stack([np.full(len(b), x), b, most - x - b], 1) for x in a if x == 0 or h[x] for b in [np.arange(x, (most - x) // 2 + 1)]]
    p = np.concatenate(rows)
    there = (h > 0) | (np.arange(len(h)) == 0)
    p = p[there[p].all(1) & (p[:, 2] > 0)]
    like = np.log(np.maximum(h, 1))[p].sum(1)
    return p[np.argsort(-like, kind="stable")[:limit]]


def fit(h: np.ndarray, p: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the patterns' lengths near the histogram in least squares."""
    if not len(p):
        return np.zeros(0)
    n = len(h)
    mask = p > 0
    up = lambda v: (v[p] * mask).sum(1)  # noqa: E731  A^T v
    down = lambda x: np.bincount(p[mask], np.repeat(x, 3).reshape(-1, 3)[mask], n)  # noqa: E731  A x
    goal = up(h.astype(float))
    x = np.full(len(p), h.sum() / (3 * len(p)) + 1e-9)
    for _ in range(rounds):
        x *= goal / (up(down(x)) + 1e-12)
    return x


def plan(h: np.ndarray, most: int) -> tuple[dict[int, np.ndarray], int]:
    """h[l]: pieces of length l. For each length an array of runs (r0, base, offset), by r0; and the number of sequences."""
    left = h.astype(np.int64).copy()
    runs: dict[int, list] = {int(x): [] for x in np.flatnonzero(h)}
    used = 0
    p = patterns(h, most)
    x = fit(h, p)
    if len(x):
        sums = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
        for lengths, want in zip(p.tolist(), np.diff(sums, prepend=0).tolist(), strict=True):
            if want <= 0:
                continue
            lengths = [v for v in lengths if v]
            n = min(want, *(int(left[v]) // lengths.count(v) for v in lengths))
            if n <= 0:
                continue
            at = 0
            for v in reversed(lengths):
                runs[v].append((int(h[v] - left[v]), used, at))
                left[v] -= n
                at += v
            used += n
    room: list[int] = []  # the amounts of room that open sequences have, in order
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)

    def put(space: int, base: int, n: int) -> None:
        if space and n:
            if space not in groups:
                groups[space] = []
                bisect.insort(room, space)
            groups[space].append((base, n))

    for v in range(len(h) - 1, 0, -1):
        while left[v]:
            k = bisect.bisect_left(room, v)
            if k < len(room):
                space = room[k]
                base, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    room.pop(k)
                take = min(n, int(left[v]))
                put(space, base + take, n - take)
            else:
                space, base = most, used
                fit_in = most // v  # the same length again and again fills new sequences
                take = -(-int(left[v]) // fit_in)
                used += take
            runs[v].append((int(h[v] - left[v]), base, most - space))
            left[v] -= take
            put(space - v, base, take)
    return {v: np.array(sorted(r), np.int64).reshape(-1, 3) for v, r in runs.items()}, used


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tmp = Scratch(spark)
    cut = tmp.write(pieces(docs, id_col, text_col, tokenizer, most))
    h = np.zeros(most + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `most` rows
        h[r["length"]] = r["count"]
    runs, _ = plan(h, most)
    sent = spark.sparkContext.broadcast(runs)

    def place(batches):
        runs = sent.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank")) - 1
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                m = length == v
                r = runs[int(v)]
                k = np.searchsorted(r[:, 0], rank[m], "right") - 1
                seq[m] = r[k, 1] + rank[m] - r[k, 0]
                off[m] = r[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).columns, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(tmp, cut, "length", ["doc_id", "piece"]).mapInArrow(place, PIECES + ", sequence_id long, offset long")
