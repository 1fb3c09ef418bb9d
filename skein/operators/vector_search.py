"""Top-k cosine search of all rows against all rows, in blocks.

Vectors are packed into blocks, a row each, that are written once to the folder that all executors share. A cross join of the blocks, without a shuffle,
brings every pair of a query block and a candidate block together; a task keeps the k best of each query as candidate blocks pass by. A product in
single precision with a bound on its error tells which pairs may count, and only these are scored in double precision, in the order in which SQL
adds. What is shuffled is each row once, and k rows for each query and each of the candidates' few partitions, so it grows with the input; the
pairs that are looked at, and so the time, are a square by nature. Nothing is broadcast, and no group grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch

BLOCK = 2048
#: Pairs scored at once, and the least partitions of candidates.
PAIRS, PARTS = 1 << 16, 4
_BLOCKS = "ids binary, documents binary, vectors binary, width int"


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows (id, document_id, embedding) as one row of bytes, without vectors that point nowhere; in single precision where that loses nothing."""
    t = pa.Table.from_batches(held).combine_chunks()
    v = t.column("embedding").combine_chunks()
    lengths = pc.unique(pc.list_value_length(v))
    if len(lengths) > 1:
        raise ValueError("all vectors must have one length")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(t.num_rows, -1)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        x, narrow = x[good], x[good].astype(np.float32)
    width = x.shape[1] if good.any() else 0
    ids, documents = (t.column(c).to_numpy().astype(np.int64)[good].tobytes() for c in ("id", "document_id"))
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([documents], pa.binary()), pa.array([(narrow if (narrow == x).all() else x).tobytes()], pa.binary()), pa.array([width], pa.int32())], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _write_blocks(rows: DataFrame, block: int, other_document: bool, folder: str) -> tuple[DataFrame, int]:
    """rows (id, document_id, embedding) as blocks in a folder, and how many there are."""
    document = F.col("document_id").cast("long")
    good = rows.where("embedding is not null and size(embedding) > 0")
    good = good.where("document_id is not null") if other_document else good  # an unknown document is not known to be another
    good = good.select(F.col("id").cast("long").alias("id"), F.coalesce(document, F.lit(0)).alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = max(1, -(-good.count() // block))

    def pack(batches):
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= 2 * block:
                yield _packed(held)
                held, count = [], 0
        if count:
            yield _packed(held)

    good.repartition(n).mapInArrow(pack, _BLOCKS).write.parquet(folder)
    return rows.sparkSession.read.schema(_BLOCKS).parquet(folder), n


class Block:
    def __init__(self, ids: bytes, documents: bytes, vectors: bytes, width: int):
        self.ids, self.documents = np.frombuffer(ids, np.int64), np.frombuffer(documents, np.int64)
        n = len(self.ids)
        kind = np.float32 if len(vectors) == 4 * n * width else np.float64
        self.x = np.frombuffer(vectors, kind).reshape(n, width).astype(np.float64)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.unit = (self.x / self.norm[:, None]).astype(np.float32)
        self.square = np.zeros(n)
        for d in range(width):
            self.square += self.x[:, d] * self.x[:, d]


def cosines(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, summed in the order of the components as SQL does, so that equal vectors tie."""
    x, y, dot = a.x[i], b.x[j], np.zeros(len(i))
    for d in range(x.shape[1]):
        dot += x[:, d] * y[:, d]
    with np.errstate(over="ignore", under="ignore"):
        both = a.square[i] * b.square[j]
    root = np.where((both > 1e-290) & (both < 1e290), np.sqrt(both), a.norm[i] * b.norm[j])
    return np.clip(dot / root, -1.0, 1.0)


class Nearest:
    """The k best candidates of each query of a block that have passed by."""

    def __init__(self, block: Block, k: int, threshold: float, other_document: bool, not_self: bool):
        self.block, self.k, self.threshold, self.other_document, self.not_self = block, k, threshold, other_document, not_self
        self.error = (block.x.shape[1] + 8) * 1.2e-7  # of a product in single precision, doubled
        self.score, self.target = np.full((len(block.ids), k), -np.inf), np.zeros((len(block.ids), k), np.int64)

    def meet(self, c: Block) -> None:
        b = self.block
        s = b.unit @ c.unit.T
        low = (np.maximum(self.score[:, -1], self.threshold) - self.error).astype(np.float32)
        may = s >= low[:, None]
        many = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * self.k + 32)
        if len(many) and s.shape[1] > self.k:  # of these rows only what is near their k best of this block
            part = s[many]
            if self.other_document:
                part[b.documents[many][:, None] == c.documents[None, :]] = -2.0
            if self.not_self:
                part[b.ids[many][:, None] == c.ids[None, :]] = -2.0
            best = np.partition(part, -self.k, axis=1)[:, -self.k]
            may[many] = part >= np.maximum(low[many], best - np.float32(2 * self.error))[:, None]
        i, j = np.nonzero(may)
        for at in range(0, len(i), PAIRS):
            self._keep(c, i[at:at + PAIRS], j[at:at + PAIRS])

    def _keep(self, c: Block, i: np.ndarray, j: np.ndarray) -> None:
        b = self.block
        ok = np.ones(len(i), bool)
        if self.other_document:
            ok &= b.documents[i] != c.documents[j]
        if self.not_self:
            ok &= b.ids[i] != c.ids[j]
        i, j = i[ok], j[ok]
        v = cosines(b, i, c, j)
        ok = (v > self.threshold) & (v >= self.score[i, -1])
        i, v, t = i[ok], v[ok], c.ids[j[ok]]
        if not len(i):
            return
        rows = np.unique(i)
        row = np.concatenate([np.repeat(rows, self.k), i])
        v, t = np.concatenate([self.score[rows].ravel(), v]), np.concatenate([self.target[rows].ravel(), t])
        order = np.lexsort((t, -v, row))
        row, v, t = row[order], v[order], t[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.score[row[kept], place[kept]], self.target[row[kept], place[kept]] = v[kept], t[kept]

    def best(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.block.ids[i]), pa.array(self.target[i, j]), pa.array(self.score[i, j])], names=["source", "target", "similarity"])


def top_k_cosine(queries: DataFrame, candidates: DataFrame, k: int, threshold: float, other_document: bool = True, not_self: bool = True, block: int = BLOCK) -> DataFrame:
    """queries and candidates (id, document_id, embedding) to source, target, similarity, rank: similarity > threshold, the k best.

    other_document: only targets of another document. Zero or null vectors have no similarity and never match. Ties go to the smaller target.
    """
    spark = queries.sparkSession
    folder = scratch(spark, "blocks")
    q, nq = _write_blocks(queries, block, other_document, f"{folder}/queries")
    c, nc = (q, nq) if candidates is queries else _write_blocks(candidates, block, other_document, f"{folder}/candidates")
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    # few partitions of candidates for many query blocks, else enough of them to keep all cores busy
    parts = min(nc, max(PARTS, -(-2 * spark.sparkContext.defaultParallelism // nq)))
    left = q.select(F.monotonically_increasing_id().alias("block"), *names)
    right = c.select(*(F.col(x).alias(f"c_{x}") for x in names)).coalesce(parts)
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)

    def best(batches):
        now, held = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                mine, theirs = ([batch.column(h + i)[r].as_py() for i in range(4)] for h in (1, 5))
                if not mine[3] or not theirs[3]:
                    continue
                if (key := batch.column(0)[r].as_py()) != now:
                    if held is not None:
                        yield held.best()
                    now, held = key, Nearest(Block(*mine), k, threshold, other_document, not_self)
                held.meet(Block(*theirs))
        if held is not None:
            yield held.best()

    local = pairs.mapInArrow(best, "source long, target long, similarity double")
    w = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
