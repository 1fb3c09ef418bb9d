"""Edges derived from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engines import best_per


def spark_connections(origins: DataFrame, mentions: DataFrame, edges: DataFrame, least: float = 0.6, k: int = 10, share: float = 0.7) -> DataFrame:
    """Notes' links: their origin (1.0), chunks they mention (0.9) and the origin's strongest links at a share of their strength."""
    out = origins.join(edges.where(F.col("strength") >= least), F.col("origin") == F.col("source")).select("spark_id", "target", "strength")
    out = best_per(out, "spark_id", k, "strength", "target").select("spark_id", F.col("target").alias("chunk_id"), F.round(F.col("strength") * share, 6).alias("w"), F.lit("inherited").alias("kind"))
    out = out.unionByName(origins.select("spark_id", F.col("origin").alias("chunk_id"), F.lit(1.0).alias("w"), F.lit("origin").alias("kind")))
    out = out.unionByName(mentions.select("spark_id", "chunk_id", F.lit(0.9).alias("w"), F.lit("mention").alias("kind")))
    return out.groupBy("spark_id", "chunk_id").agg(F.max("w").alias("weight"), F.max_by("kind", F.struct("w", "kind")).alias("kind"))
