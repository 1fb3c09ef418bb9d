"""Where needles stand in texts, exactly or nearly: seeds that every good window must hold, then windows scored only where the seeds are.

A window as long as the needle is a hit if the sets of trigrams of both have a Jaccard similarity of `threshold` t or more. Then at least t of the needle's
own trigrams are in the window: |A n B| >= t |A u B| >= t |A|. So
1. a text that holds fewer than t of a needle's trigrams has no hit. One look-up of a text's distinct trigrams in the inverted lists of all needles
   counts them for every needle at once;
2. of the others, each window lies within a few cells of CELL characters, as many as its length needs, and cells with fewer than t of the needle's
   trigrams hold no hit. All needles' trigrams in all runs of cells are counted by products of matrices; only windows that begin where enough are found
   are scored.
No hit is lost by either step, and rows come out only for hits.

Needles are a stated set of queries: they travel to the texts in blocks of bounded bytes, and each block reads the texts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import Hit, set_similarity, squeeze, trigram_set, windows

BLOCK_BYTES, BLOCK_ROWS = 48 << 10, 500  # of needles that are sent at once
CELL, CELLS = 128, 1024  # characters of a cell, cells that are looked at together
OUT = "needle_id long, document_id long, start int, end int, confidence double, method string"


def gram_keys(text: str) -> np.ndarray:
    """A number for each trigram of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)


class Needles:
    """The inverted lists of a block of needles."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = 0.75):
        self.rows = [(i, n, " ".join(n.split())) for i, n in rows]
        self.threshold = threshold
        self.grams = [trigram_set(c) for _, _, c in self.rows]
        keys = [np.unique(gram_keys(c.lower())) for _, _, c in self.rows]
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))
        own = [np.searchsorted(self.keys, k) for k in keys]
        flat, of = np.concatenate([np.zeros(0, np.int64), *own]), np.repeat(np.arange(len(own)), [len(o) for o in own])
        order = np.argsort(flat, kind="stable")
        self.lists, self.at = of[order], np.searchsorted(flat[order], np.arange(len(self.keys) + 1))
        self.own, self.least = own, np.array([threshold * len(g) * (1 - 1e-9) for g in self.grams])
        self.incidence = np.zeros((len(self.rows), len(self.keys)), np.float32)  # at most BLOCK_ROWS x BLOCK_BYTES
        self.incidence[of, flat] = 1
        self.tried = 0  # windows scored

    def numbers(self, text: str) -> np.ndarray:
        """The number of each trigram of the text among the needles' own, -1 for others."""
        k = gram_keys(text)
        if not len(self.keys) or not len(k):
            return np.full(len(k), -1)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, at, -1)

    def hits(self, text: str):
        """(number of the needle, hit) of every needle that the text holds."""
        s = " ".join(text.split())
        low = s.lower()
        bounded = "Σ" not in s  # its small letter depends on what stands around it
        numbers = self.numbers(low)
        here = np.unique(numbers[numbers >= 0])
        spans = self.at[here + 1] - self.at[here]
        lists = self.lists[np.repeat(self.at[here] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())]
        counts = np.bincount(lists, minlength=len(self.rows))
        left = []
        for j in np.flatnonzero((counts >= self.least) if bounded else np.ones(len(self.rows), bool)).tolist():
            hit = self._exact(j, text, s)
            if hit is not None:
                yield j, hit
            elif self.rows[j][2] and len(s) >= len(self.rows[j][2]):
                left.append(j)
        sure = bounded and len(low) == len(s)
        starts = self._cells([j for j in left if self.grams[j]], numbers) if sure else {}
        for j in left:
            c = self.rows[j][2]
            if sure and self.grams[j]:
                if j not in starts:
                    continue
                grid = np.asarray(windows(c, s))
                grid = grid[np.isin(grid // CELL, starts[j])]
            else:
                grid = np.asarray(windows(c, s))
            hit = self._score(j, text, s, grid)
            if hit is not None:
                yield j, hit

    def _exact(self, j: int, text: str, s: str) -> Hit | None:
        _, raw, c = self.rows[j]
        k = text.find(raw)
        if raw and k >= 0:
            return Hit(k, k + len(raw), 1.0, "exact")
        k = s.find(c) if c else -1
        if k < 0:
            return None
        at = squeeze(text)[1]
        return Hit(at[k], at[k + len(c) - 1] + 1, 1.0, "exact")

    def _cells(self, needles: list[int], numbers: np.ndarray) -> dict[int, np.ndarray]:
        """For each needle the cells in which a window may begin that holds enough of its trigrams.

        A window that begins in a cell ends `wide` cells on at most; the trigrams of so many cells are counted for all needles of one width by one product.
        """
        out: dict[int, np.ndarray] = {}
        if not needles:
            return out
        p = np.flatnonzero(numbers >= 0)
        widths: dict[int, list[int]] = {}
        for j in needles:
            widths.setdefault(-(-(CELL - 1 + len(self.rows[j][2])) // CELL), []).append(j)
        most = max(widths)
        cells = -(-max(1, len(numbers)) // CELL)
        for first in range(0, cells, CELLS):  # some cells at a time bound the memory
            n = min(CELLS, cells - first)
            own = p[np.searchsorted(p, first * CELL):np.searchsorted(p, (first + n + most) * CELL)]
            held = np.zeros((n + most, len(self.keys)), bool)
            held[own // CELL - first, numbers[own]] = True
            union, done = held[:n].copy(), 1
            for wide in sorted(widths):
                for k in range(done, wide):
                    union |= held[k:n + k]
                done, some = wide, widths[wide]
                cell, x = np.nonzero(union.astype(np.float32) @ self.incidence[some].T >= self.least[some])
                for j in np.unique(x).tolist():
                    found = cell[x == j] + first
                    out[some[j]] = np.concatenate([out[some[j]], found]) if some[j] in out else found
        return out

    def _score(self, j: int, text: str, s: str, starts: np.ndarray) -> Hit | None:
        c, best, where = self.rows[j][2], 0.0, -1
        for k in starts.tolist():
            self.tried += 1
            v = set_similarity(self.grams[j], trigram_set(s[k:k + len(c)]))
            if v > best:
                best, where = v, k
            if best > 0.95:
                break
        if best < self.threshold:
            return None
        at = squeeze(text)[1]
        return Hit(at[where], at[min(len(s), where + len(c)) - 1] + 1, best, "fuzzy")


def seek(needles: DataFrame, texts: DataFrame, threshold: float = 0.75) -> DataFrame:
    """needles (needle_id, needle) in texts (document_id, text): needle_id, document_id, start, end, confidence, method, one row for each pair that hits.

    Null needles and texts have no hits. Of equally good windows the first counts; places are in the raw text. Rows that repeat a document are sought each.
    """
    needles = needles.where("needle is not null").select(F.col("needle_id").cast("long").alias("needle_id"), "needle")
    size = needles.agg(F.sum(F.octet_length("needle")).alias("bytes"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES), -(-size["rows"] // BLOCK_ROWS))
    texts = texts.where("text is not null").select(F.col("document_id").cast("long").alias("document_id"), "text")
    found = None
    for b in range(blocks):
        rows = needles.where(F.pmod(F.xxhash64("needle_id", "needle"), F.lit(blocks)) == b).collect()  # a block of the queries
        sent = texts.sparkSession.sparkContext.broadcast([(r["needle_id"], r["needle"]) for r in rows])

        def run(batches, sent=sent):
            block = Needles(sent.value, threshold)
            for batch in batches:
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for j, h in block.hits(text):
                        for o, v in zip(out, (block.rows[j][0], doc, h.start, h.end, h.confidence, h.method), strict=True):
                            o.append(v)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["needle_id", "document_id", "start", "end", "confidence", "method"])

        part = texts.mapInArrow(run, OUT)
        found = part if found is None else found.unionByName(part)
    return found
