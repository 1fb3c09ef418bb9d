"""Chunks of one topic: boundaries where the sentences before and behind are least alike, from vectors of an injected model.

Texts become rows of sentences with exact offsets; the model gets sentences, some at a time and of any documents, never a whole document. For each gap between
two sentences the sums of the vectors of up to SIDE sentences on either side are compared by cosine. A gap is a boundary if its similarity is a dip (no
neighbouring gap is lower, and it lies `depth` standard deviations below the mean of its document's gaps) and the chunk before has `least`
sentences; chunks beyond `most` words end at the next sentence. Vectors stay in the task that reads a text, a few at a time; rows carry one number for their
gap, and the rest are windows over sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import sentence_spans

SIDE, DIM = 3, 64
Embed = Callable[[list[str]], np.ndarray]


_WORD = re.compile(r"\w+")


class _Places(dict):
    """Where words are counted; forgets when it knows too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode()) % DIM
        return out


_places = _Places()


def hashed_words(sentences: list[str]) -> np.ndarray:
    """A stand-in for a model: counts of hashed words in DIM places."""
    places: list[int] = []
    counts = []
    for s in sentences:
        words = _WORD.findall(s.lower())
        places += [_places[w] for w in words]
        counts.append(len(words))
    at = np.repeat(np.arange(len(sentences)) * DIM, counts) + np.array(places, np.int64)
    return np.bincount(at, minlength=len(sentences) * DIM).astype(float).reshape(len(sentences), DIM)


def gaps(vectors: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row the cosine of the sums of up to SIDE vectors up to it and behind it, of rows of the same number; 2 behind the last row of one."""
    n = len(vectors)
    before, behind, there = vectors.copy(), np.zeros_like(vectors), np.zeros(n, bool)
    for k in range(1, SIDE + 1):
        same = (of[k:] == of[:-k])[:, None] if n > k else np.zeros((0, 1), bool)
        if k < SIDE:
            before[k:] += np.where(same, vectors[:-k], 0)
        behind[:n - k] += np.where(same, vectors[k:], 0)
        if k == 1:
            there[:n - 1] = same[:, 0]
    norm = np.sqrt((before * before).sum(1)) * np.sqrt((behind * behind).sum(1))
    cos = np.divide((before * behind).sum(1), norm, out=np.zeros(n), where=norm > 0)
    return np.where(there, cos, 2.0)


def sentences(docs: DataFrame, embed: Embed, lot: int = 256) -> DataFrame:
    """docs (document_id, text) to rows of sentences: document_id, seq, start, end, words, content, gap (null behind the last)."""

    def run(batches):
        held: list[tuple] = []  # (number of the document, id, seq, start, end, words, content)
        known = np.zeros((0, 0))  # vectors of the first rows of `held`
        done, number = 0, 0  # rows of `held` that only look back

        def settle(open_document: int | None, kind):
            """Vectors for all held rows; those whose neighbours are all there go out."""
            nonlocal known, done
            if len(held) > len(known):
                new = np.asarray(embed([r[6] for r in held[len(known):]]), float)
                known = np.concatenate([known, new]) if len(known) else new
            end = len(held)
            while end > done and open_document is not None and held[end - 1][0] == open_document and len(held) - end < SIDE:
                end -= 1
            if end > done:
                g = gaps(known, np.array([r[0] for r in held]))[done:end]
                cols = list(zip(*held[done:end], strict=True))[1:]
                types = (kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(np.where(g > 1.5, np.nan, g), mask=g > 1.5)], names=["document_id", "seq", "start", "end", "words", "content", "gap"])
            cut = max(0, end - SIDE)
            del held[:cut]
            known, done = known[cut:], end - cut

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number += 1
                for k, (a, b) in enumerate(sentence_spans(text or "")):
                    held.append((number, doc, k, a, b, len(text[a:b].split()), text[a:b]))
                    if len(held) - len(known) >= lot:
                        yield from settle(number, kind)
            yield from settle(None, kind)

    kind = dict(docs.dtypes)["document_id"]
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, seq int, start int, end int, words int, content string, gap double")


def semantic_chunks(docs: DataFrame, embed: Embed = hashed_words, depth: float = 1.0, least: int = 2, most: int = 400) -> DataFrame:
    """document_id, chunk_index, start_offset, end_offset, content: docs (document_id, text) cut where topics change.

    Ids must tell documents apart. Null and blank texts have no chunks. least counts sentences since the last dip of any depth. Zero vectors are like nothing.
    """
    rows = sentences(docs, embed)
    by = Window.partitionBy("document_id").orderBy("seq")
    whole = Window.partitionBy("document_id")
    low = F.avg("gap").over(whole) - F.lit(depth) * F.coalesce(F.stddev_pop("gap").over(whole), F.lit(0.0))
    # of equal neighbours the first is the dip
    dip = (F.col("gap") < F.coalesce(F.lag("gap").over(by), F.lit(2.0))) & (F.col("gap") <= F.coalesce(F.lead("gap").over(by), F.lit(2.0))) & (F.col("gap") < low)
    rows = rows.withColumn("dip", F.coalesce(dip, F.lit(False)))
    last = F.max(F.when(F.col("dip"), F.col("seq"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("cut", F.col("dip") & (F.col("seq") - F.coalesce(last, F.lit(-1)) >= least))
    so_far = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("cut").cast("int")).over(so_far), F.lit(0)))
    own = Window.partitionBy("document_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("piece", F.floor((F.sum("words").over(own) - 1) / most))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "")
    chunks = rows.groupBy("document_id", "part", "piece").agg(F.min("start").alias("start_offset"), F.max("end").alias("end_offset"), joined.alias("content"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("start_offset")) - 1
    return chunks.select("document_id", index.alias("chunk_index"), "start_offset", "end_offset", "content")
