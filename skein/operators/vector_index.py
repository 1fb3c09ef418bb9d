"""An inverted-file index over vectors: a coarse quantiser, lists as a partitioned table, exact ranking inside the lists that a query probes.

`build` fits centres by spherical k-means on a bounded sample and gives every row to its nearest centre. The table below `rows/` is partitioned by
list, so a scan reads only the lists asked for. `sizes/` has one row per list: its rows and the least cosine of a row with its centre.
`search` chooses lists per query: those whose centre is at most a margin less similar to the query than the nearest centre. The margin is measured when
the index is built, on the neighbours that TRIALS rows of the sample have in it, so that the share asked for lies within; `probes` sets a number of
lists instead. `exact=True` probes every list that can hold a
similarity above the threshold (angles obey the triangle inequality), and gives what a search of all rows gives.

Lists and their queries are met in tiles of LIST_ROWS x QUERY_ROWS, so a list that holds a third of all rows is many tasks; after a tile k rows for each
of its queries go on. Centres (at most LISTS x the vectors' length) are the only broadcast. Null vectors and zero vectors are in no list and never match.
Vectors of one length are assumed; others are refused when the index is built.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that the quantiser is fitted on, and most centres; every row is indexed.
SAMPLE, LISTS = 50_000, 4096
LIST_ROWS, QUERY_ROWS, TRIALS = 4096, 1024, 512
ROWS = "id long, document_id long, embedding array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_centres(x: np.ndarray, n: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit vectors that n groups of the rows gather around; empty groups begin anew at the row that fits worst."""
    x = unit(x)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        of = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(s.max(1), kind="stable")[:len(empty)]]
        new = unit(sums)
        if np.allclose(new, c):
            break
        c = new
    return c


def margin_for(x: np.ndarray, documents: np.ndarray, centres: np.ndarray, recall: float, k: int, threshold: float) -> float:
    """How much less similar than the nearest centre the list of a neighbour's is, for the given share of the neighbours of TRIALS rows."""
    x = unit(x)
    of, gaps = (x @ centres.T).argmax(1), []
    for i in np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int):
        s = x @ x[i]
        s[documents == documents[i]] = -2.0
        near = np.argsort(-s, kind="stable")[:k]
        own = centres @ x[i]
        gaps.extend(own.max() - own[of[near[s[near] > threshold]]])
    return float(np.quantile(gaps, recall)) if gaps else 2.0


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    v = batch.column(name)
    return np.asarray(v.flatten(), np.float64).reshape(batch.num_rows, -1)


def _good(rows: DataFrame) -> DataFrame:
    """id, document_id, embedding of rows that have a vector that points somewhere."""
    v = F.col("embedding").cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("id").cast("long").alias("id"), F.col("document_id").cast("long").alias("document_id"), v.alias("embedding"))


class VectorIndex:
    """A written index: folder/rows, folder/sizes, folder/centres."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.sizes = spark.read.parquet(f"{folder}/sizes")
        rows = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()  # at most LISTS
        self.centres = np.array([r["centre"] for r in rows]).reshape(len(rows), len(rows[0]["centre"]) if rows else 0)
        self.margin = rows[0]["margin"] if rows else 2.0

    @staticmethod
    def build(rows: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE, recall: float = 0.95, k: int = 10, threshold: float = 0.3) -> VectorIndex:
        """Index rows (id, document_id, embedding) below folder. lists: about the root of the number of rows unless given.

        recall, k, threshold: the share of the k nearest rows of other documents above the threshold that searches should find.
        """
        spark = rows.sparkSession
        good = _good(rows)
        found = good.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if found["low"] != found["high"]:
            raise ValueError("all vectors must have one length")
        n = found["n"]
        lists = max(1, min(LISTS, n, lists or math.isqrt(max(1, n))))
        some = good if n <= sample else good.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
        drawn = list(some.select("embedding", "document_id").toLocalIterator())
        got = np.array([r["embedding"] for r in drawn])
        centres = fit_centres(got, lists) if n else np.zeros((0, 1))
        margin = margin_for(got, np.array([-1 if r["document_id"] is None else r["document_id"] for r in drawn]), centres, recall, k, threshold) if n else 2.0
        spark.createDataFrame([(i, c.tolist(), margin) for i, c in enumerate(centres)], "list int, centre array<double>, margin double").write.parquet(f"{folder}/centres")
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches):
            for b in batches:
                s = unit(_vectors(b, "embedding")) @ sent.value.T
                of = s.argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.max(1)), pa.array(of)], names=["id", "document_id", "embedding", "nearness", "list"])

        placed = good.mapInArrow(assign, f"{ROWS}, nearness double, list int")
        # a hot list's rows are dealt out, so that no task writes it alone
        placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (lists * LIST_ROWS))))).write.partitionBy("list").parquet(f"{folder}/rows")
        stored = spark.read.schema(f"{ROWS}, nearness double, list int").parquet(f"{folder}/rows")
        stored.groupBy("list").agg(F.count("*").alias("rows"), F.min("nearness").alias("nearest")).write.parquet(f"{folder}/sizes")
        return VectorIndex(spark, folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{ROWS}, nearness double, list int").parquet(f"{self.folder}/rows")

    def chosen(self, queries: DataFrame, probes: int | None, threshold: float, exact: bool) -> DataFrame:
        """id, document_id, embedding, list, centre_rank of the lists that each query reads."""
        if not len(self.centres):
            return _good(queries).where(F.lit(False)).select("*", F.lit(0).alias("list"), F.lit(0).alias("centre_rank"))
        sizes = self.sizes.collect()  # a row per list
        nearest = np.full(len(self.centres), 2.0)
        nearest[[r["list"] for r in sizes]] = [r["nearest"] for r in sizes]
        margin = self.margin
        sent = self.spark.sparkContext.broadcast((self.centres, np.arccos(np.clip(nearest, -1, 1)), nearest < 2))

        def choose(batches):
            centres, radius, filled = sent.value
            angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-7
            for b in batches:
                s = unit(_vectors(b, "embedding")) @ centres.T
                s[:, ~filled] = -2.0
                order = np.argsort(-s, axis=1, kind="stable")
                if exact:
                    may = np.take_along_axis((np.arccos(np.clip(s, -1, 1)) - radius <= angle) & filled, order, 1)
                elif probes is None:
                    may = np.take_along_axis((s >= s.max(1, keepdims=True) - margin) & filled, order, 1)
                else:
                    may = (np.arange(len(centres)) < probes) & np.take_along_axis(np.broadcast_to(filled, s.shape), order, 1)
                i, j = np.nonzero(may)
                for at in range(0, len(i), 1 << 13):
                    k, m = i[at:at + (1 << 13)], j[at:at + (1 << 13)]
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(k)).columns, pa.array(order[k, m].astype(np.int32)), pa.array(m.astype(np.int32))], names=["id", "document_id", "embedding", "list", "centre_rank"])

        return _good(queries).mapInArrow(choose, f"{ROWS}, list int, centre_rank int")

    def search(self, queries: DataFrame, k: int, threshold: float, probes: int | None = None, exact: bool = False, other_document: bool = True, not_self: bool = True, where: str | None = None) -> DataFrame:
        """source, target, similarity, rank: the k most similar rows above the threshold; ties go to the smaller target.

        where: a condition on the indexed rows' columns (id, document_id), applied in the scan.
        """
        asked = self.chosen(queries, probes, threshold, exact)
        tiles_q = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("tq"))
        tiles = self.sizes.select("list", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("tc")).join(tiles_q, "list")  # a row per list
        tiles = F.broadcast(tiles)
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(tiles, "list").select("list", deal("tq").alias("q"), all_of("tc").alias("c"), F.lit(0).alias("side"), "id", "document_id", "embedding")
        stored = self.rows() if where is None else self.rows().where(where)
        c = stored.join(tiles, "list").select("list", all_of("tq").alias("q"), deal("tc").alias("c"), F.lit(1).alias("side"), "id", "document_id", "embedding")

        def best(part: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"source": [], "target": [], "similarity": []}).astype({"source": "int64", "target": "int64", "similarity": "float64"})
            a, b = part[part["side"] == 0], part[part["side"] == 1].sort_values("id")
            if not len(a) or not len(b):
                return none
            x, y = np.stack(a["embedding"].to_numpy()), np.stack(b["embedding"].to_numpy())
            s = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
            if other_document:
                s[a["document_id"].to_numpy()[:, None] == b["document_id"].to_numpy()[None, :]] = -2.0
            if not_self:
                s[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -2.0
            s[s <= threshold] = -2.0
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(s, order, 1)
            i, j = np.nonzero(top > -2.0)
            return pd.DataFrame({"source": a["id"].to_numpy()[i], "target": b["id"].to_numpy()[order[i, j]], "similarity": top[i, j]})

        local = q.unionByName(c).groupBy("list", "q", "c").applyInPandas(best, "source long, target long, similarity double")
        w = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
        return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def rows_read(self, queries: DataFrame, probes: int | None = None, threshold: float = 0.0, exact: bool = False) -> DataFrame:
        """id, lists, rows_read: what each query reads."""
        return self.chosen(queries, probes, threshold, exact).join(F.broadcast(self.sizes), "list").groupBy("id").agg(F.count("*").alias("lists"), F.sum("rows").alias("rows_read"))
