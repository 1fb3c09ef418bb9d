"""Ordered computations."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir, so that all readers see the same rows; in local mode, where that is unset, in one of our own."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir() and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-checkpoint-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers 1..n over the whole frame without gathering it: a range-partitioned sort, then each partition's rows before it.

    The order must be total. Only one row a partition meets in the window over partitions.
    """
    s = settled(df.sort(*order).withColumn("_mid", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_mid", 33))
    per = s.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    return s.join(F.broadcast(per), "_p").withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1) + 1).drop("_mid", "_p", "_before")


def rank_within(df: DataFrame, group: str, order: list[Column], name: str = "rank", ties: list[Column] | None = None) -> DataFrame:
    """Row numbers 1..n within each group in a total order, without a task that holds a group: global ranks less the least of the group.

    ties: rows of a group that are equal in these share the least of their numbers, as rank() does.
    """
    from functools import reduce

    g = global_rank(df, [F.col(group).asc_nulls_first(), *order], "_g")
    first = g.groupBy(F.col(group).alias("_key")).agg(F.min("_g").alias("_first"))
    at = F.col("_g")
    if ties:
        names = [f"_t{i}" for i in range(len(ties))]
        low = g.groupBy(F.col(group).alias("_own"), *(t.alias(n) for t, n in zip(ties, names, strict=True))).agg(F.min("_g").alias("_low"))
        g = g.withColumns(dict(zip((f"{n}v" for n in names), ties, strict=True)))
        on = reduce(lambda a, b: a & b, (F.col(f"{n}v").eqNullSafe(F.col(n)) for n in names), F.col(group).eqNullSafe(F.col("_own")))
        g, at = g.join(low, on).drop("_own", *names, *(f"{n}v" for n in names)), F.col("_low")
    return g.join(first, F.col(group).eqNullSafe(F.col("_key"))).withColumn(name, at - F.col("_first") + 1).drop("_g", "_key", "_first", *(["_low"] if ties else []))


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the smallest value that a share of the group's values does not exceed (percentile_disc), one column for each share.

    Values are ranked by one range-partitioned sort; only the rows that are asked for leave it, so no task holds a group's values. Nulls do not count.
    """
    tie = F.monotonically_increasing_id()
    g = global_rank(df.where(F.col(value).isNotNull()).select(group, value, tie.alias("_tie")), [F.col(group).asc_nulls_first(), F.col(value), F.col("_tie")], "_g")
    n = g.groupBy(group).agg(F.min("_g").alias("_first"), F.count("*").alias("_n"))
    at = F.array(*(F.struct(F.lit(k).alias("name"), (F.col("_first") - 1 + F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n") - F.lit(1e-9)))).cast("long").alias("g")) for k, q in shares.items()))
    asked = n.select(F.explode(at).alias("a")).select("a.name", F.col("a.g").alias("_g"))
    met = g.join(asked, "_g")
    return met.groupBy(group).agg(*(F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in shares))


def running_offset(df: DataFrame, key: str, order: str, text: str, gap: int = 1) -> DataFrame:
    """n (characters of text) and start_char: where each row begins if a key's texts stand in order, `gap` characters apart. Null texts are empty."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.length(text), F.lit(0))
    return df.withColumn("n", n).withColumn("start_char", F.sum(F.col("n") + gap).over(w) - F.col("n") - gap)
