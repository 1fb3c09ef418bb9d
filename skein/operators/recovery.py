"""Carrying edges and notes over to re-made chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import top_k_cosine


def nearest(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """source, target, similarity, rank of each old chunk's k nearest new ones; similarities equal to 9 places go to the smaller id."""
    return top_k_cosine(old, new, k, -1.5, other_document=False, not_self=False)


def remap_edges(edges: DataFrame, old: DataFrame, new: DataFrame, success: float = 0.95, review: float = 0.85) -> DataFrame:
    """Edges with an end among the old chunks: each such end goes to its nearest new chunk; the weaker end decides the outcome.

    Lost edges keep their ends and stay in the result, marked as lost.
    """
    n = nearest(old, new, 1)
    s = n.select(F.col("source").alias("so"), F.col("target").alias("sn"), F.col("similarity").alias("ss"))
    g = n.select(F.col("source").alias("go"), F.col("target").alias("gn"), F.col("similarity").alias("gs"))
    r = edges.join(s, F.col("source") == F.col("so"), "left").join(g, F.col("target") == F.col("go"), "left").where("so is not null or go is not null")
    sim = F.least(F.coalesce("ss", F.lit(1.0)), F.coalesce("gs", F.lit(1.0)))
    keep = F.col("similarity") >= review
    r = r.withColumn("similarity", sim)
    return r.select("source", "target", "connection_type", F.when(keep, F.coalesce("sn", "source")).otherwise(F.col("source")).alias("new_source"), F.when(keep, F.coalesce("gn", "target")).otherwise(F.col("target")).alias("new_target"), "similarity",
                    F.when(F.col("similarity") >= success, "success").when(keep, "review").otherwise("lost").alias("outcome"))


def recover_thoughts(notes: DataFrame, chunks: DataFrame, success: float = 0.85, review: float = 0.70) -> DataFrame:
    """Each note's three nearest chunks and the outcome by the best of them."""
    n = nearest(notes, chunks, 3)
    rows = F.array_sort(F.collect_list(F.struct("rank", "target")))
    out = n.groupBy(F.col("source").alias("spark_id")).agg(F.transform(rows, lambda x: x["target"]).alias("chunk_ids"), F.max("similarity").alias("similarity"))
    return out.withColumn("outcome", F.when(F.col("similarity") > success, "success").when(F.col("similarity") > review, "review").otherwise("lost"))
