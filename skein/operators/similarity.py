"""Similarity of two texts a row, many rows at a time in numpy: shared trigrams and edit distances, equal to the column expressions of functions.sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import edit_distance

#: Words of 64 bits up to which many pairs are worked at once, least pairs a word for that, and pairs and characters that are gathered first.
WORDS, LEAST, PAIRS, CHARS = 16, 32, 1 << 15, 1 << 24


def trigram_codes(text: str) -> np.ndarray:
    """The distinct runs of three code points, as numbers of 63 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) if len(c) > 2 else np.empty(0, np.uint64)


def trigram_counts(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, and of the trigrams of the lower-cased texts a and b: both (shared), n_a, n_b; null where a text is null."""
    kinds = dict(df.dtypes)

    def run(batches):
        for rows in batches:
            found = []
            for x, y in zip(rows["_a"], rows["_b"], strict=True):
                if x is None or y is None:
                    found.append((None, None, None))
                    continue
                g, h = trigram_codes(x), trigram_codes(y)
                found.append((len(np.intersect1d(g, h, assume_unique=True)), len(g), len(h)))
            out = pd.DataFrame(found, columns=["both", "n_a", "n_b"], dtype="Int64", index=rows.index)
            yield pd.concat([rows[keys], out], axis=1)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "both long, n_a long, n_b long"])
    return df.select(*keys, F.lower(a).alias("_a"), F.lower(b).alias("_b")).mapInPandas(run, schema)


def _distances(pairs: list[tuple[bytes, bytes]], words: int) -> np.ndarray:
    """Edit distances of pairs (the shorter text first, of at most 64 * words signs below 128): Myers' bit vectors, a column of all pairs at a time."""
    one, top, p = np.uint64(1), np.uint64(63), len(pairs)
    m, n = (np.array([len(x[k]) for x in pairs]) for k in (0, 1))
    order = np.argsort(-n, kind="stable")
    m, n = m[order], n[order]
    text = np.zeros((n.max(initial=0), p), np.uint8)
    at = np.zeros((words, 128 * p), np.uint64)  # where each sign stands in the shorter text
    for r, k in enumerate(order):
        short, long = (np.frombuffer(x, np.uint8) for x in pairs[k])
        text[:len(long), r] = long
        for w in range(-(-len(short) // 64)):
            part = short[64 * w:64 * w + 64].astype(np.int64)
            np.bitwise_or.at(at[w], part * p + r, one << np.arange(len(part), dtype=np.uint64))
    up, down = np.full((words, p), ~np.uint64(0)), np.zeros((words, p), np.uint64)
    active = np.searchsorted(-n, -np.arange(len(text)), side="left")  # pairs whose longer text has a sign at j
    columns = np.arange(p)
    for j, a in enumerate(active):
        place = text[j, :a].astype(np.int64) * p + columns[:a]
        more_in, less_in = np.ones(a, np.uint64), np.zeros(a, np.uint64)
        for w in range(words):
            eq, u, d = at[w][place], up[w, :a], down[w, :a]
            v = eq | d
            eq |= less_in
            h = (((eq & u) + u) ^ u) | eq
            more, less = d | ~(h | u), u & h
            more_out, less_out = more >> top, less >> top
            more, less = more << one | more_in, less << one | less_in
            up[w, :a], down[w, :a] = less | ~(v | more), more & v
            more_in, less_in = more_out, less_out
    out = n.astype(np.int64)
    for w in range(words):
        bits = np.clip(m - 64 * w, 0, 64)
        mask = np.where(bits == 64, ~np.uint64(0), (one << (bits % 64).astype(np.uint64)) - one)
        out += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask).astype(np.int64)
    back = np.empty(p, np.int64)
    back[order] = out
    return back


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The edit distance of each pair: short ones many at a time, long ones and those beyond ASCII each in the bits of whole integers."""
    out = np.zeros(len(a), np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        n = -(-min(len(x), len(y)) // 64)
        groups.setdefault((n, max(len(x), len(y)).bit_length()) if 0 < n <= WORDS and x.isascii() and y.isascii() else (0, 0), []).append(i)
    for (words, _), rows in groups.items():
        if not words or len(rows) < LEAST * words:
            out[rows] = [edit_distance(a[i], b[i]) for i in rows]
        else:
            out[rows] = _distances([(x, y) if len(x) <= len(y) else (y, x) for x, y in ((a[i].encode(), b[i].encode()) for i in rows)], words)
    return out


def line_distances(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, distance and n (the longer length) of rows of two texts that are not null."""
    kinds = dict(df.dtypes)

    def found(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        x, y = rows[a].tolist(), rows[b].tolist()
        return rows[keys].assign(distance=edit_distances(x, y), n=[max(len(s), len(t)) for s, t in zip(x, y, strict=True)])

    def run(batches):
        held, pairs, chars = [], 0, 0
        for rows in batches:
            held.append(rows)
            pairs += len(rows)
            chars += int(rows[a].str.len().sum() + rows[b].str.len().sum())
            if pairs >= PAIRS or chars >= CHARS:
                yield found(held)
                held, pairs, chars = [], 0, 0
        if held:
            yield found(held)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "distance int, n int"])
    return df.select(*keys, a, b).mapInPandas(run, schema)
