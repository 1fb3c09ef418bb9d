"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets: the sources share `share` times all words by their weights; a target stops at `most` times its source's words and the
excess is shared again among the others. That is filling with water: sources in order of (limit / weight) are full as long as
the level reached by the rest stands above them, so one pass of running sums over one row a source gives every target.

Sampling: each document of a source is expected target / source words times. Within a source the documents are ordered by size
and id, their expected copies summed from the front, one random offset added (fixed by the source's name and the seed), and
a copy emitted for each integer passed. As sizes rise along the order, a source's words miss its target by no more than its largest
document. No document is taken more than ceil(most) times.

Ranks come from one sort whose key ends in the document's id, so that a source with a third of all rows is spread over tasks.

Defined results: null text: size 0. Null source: a source of its own, last. Null ids sort first within their size. Repeated
rows: each is a document. Sources without words: target 0. Empty table: no rows. mix() reads no other columns; mixed_documents() keeps them all,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, ranked

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with `target`."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("limit", F.col("source_size") * most)
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("open", F.when(F.col("limit") > F.col("level") * F.col("w"), F.struct(F.row_number().over(fill).alias("k"), "level")))
    s = s.withColumn("last", F.min("open").over(everything)["level"])
    return s.withColumn("target", F.coalesce(F.least("limit", F.col("last") * F.col("w")), "limit")).select("source", "source_size", "target")


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """One row per row of docs: id_col, source, text_hash, size, source_size, target, copies, taken."""
    tmp = Scratch(spark)
    sized = tmp.write(docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))  # texts are read once
    r = ranked(tmp, sized, "source", ["size", id_col])
    t = targets(r.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "_s")
    r = r.join(t, r["source"].eqNullSafe(t["_s"])).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    passed = lambda k: F.floor(rate * k + start)
    copies = F.least(passed(F.col("rank")) - passed(F.col("rank") - 1), F.ceil(F.lit(most)))
    return r.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies")).select(id_col, "source", "text_hash", "size", "source_size", "target", "copies", "taken")


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it. Rows that repeat a document share their copies."""
    m = mix(spark, docs, id_col, text_col, source_col, **options).groupBy(F.col(id_col).alias("i"), F.col("source").alias("s"), F.col("text_hash").alias("h")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    m = Scratch(spark).write(m).where("copies > 0")
    # rows travel as one column, so that no name of theirs meets one of ours
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{source_col}`").cast("string").alias("s"), F.xxhash64(text_col).alias("h"))
    same = F.col("d.i").eqNullSafe(F.col("m.i")) & (F.col("d.h") == F.col("m.h")) & F.col("d.s").eqNullSafe(F.col("m.s"))
    met = lambda some: d.alias("d").join(m.where(some).alias("m"), same).select("d.row", "d.i", "d.s", "d.h", "m.copies")
    rows = met("rows = 1").unionByName(met("rows > 1").dropDuplicates(["i", "s", "h"]))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
