"""Clusters, periods and streaks in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusters(points: DataFrame, key: str, ts: str, tie: str, max_gap_hours: float = 24.0) -> DataFrame:
    """Runs of points no more than max_gap_hours apart (a gap of exactly that much joins): start, end, n, centroid, density per hour."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    p = points.withColumn("_s", s).withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(w) > max_gap_hours * 3600).cast("int"), F.lit(0)))
    p = p.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy(key, "cluster").agg(F.min("_s").alias("a"), F.max("_s").alias("b"), F.count("*").alias("n"))
    hours = (F.col("b") - F.col("a")) / 3600
    density = F.when(F.col("n") == 1, 0.0).when(hours == 0, 1.0).otherwise(F.col("n") / F.greatest(F.lit(1.0), hours))
    return g.select(key, "cluster", "n", F.col("a").alias("start_s"), F.col("b").alias("end_s"), ((F.col("a") + F.col("b")) / 2).alias("centroid_s"), density.alias("density"))


def periodicity(points: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """periodic (coefficient of variation of the gaps below 0.3), burst (longest over 10 x shortest, shortest under an hour) or irregular; from three points on."""
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(key).orderBy(ts, tie))) / 3.6e9
    g = points.withColumn("gap", gap).groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.min("gap").alias("low"), F.max("gap").alias("high")).where("n >= 3")
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean"))
    kind = F.when(cv < 0.3, "periodic").when((F.col("high") > 10 * F.col("low")) & (F.col("low") < 1), "burst").otherwise("irregular")
    return g.select(key, "n", F.col("mean").alias("mean_hours"), cv.alias("cv"), kind.alias("kind"))


def streaks(days: DataFrame, key: str, day: str, as_of: str) -> DataFrame:
    """Per key the number of consecutive days that end on as_of (0 if none does)."""
    d = days.select(key, F.col(day).alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(key).orderBy("d")))
    runs = d.withColumn("i", island).groupBy(key, "i").agg(F.max("d").alias("last"), F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("last") == F.lit(as_of).cast("date"), F.col("n"))), F.lit(0)).alias("streak"))


def parse_time(text):
    """ISO and four common written forms; null where none fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMM d, yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def relative_time(text, as_of):
    """'3 days ago' and the like, seen from as_of; null otherwise."""
    n = F.try_to_number(F.regexp_extract(text, r"(?i)^\s*(\d+)\s+(minute|hour|day|week)s?\s+ago\s*$", 1), F.lit("999999")).cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*(\d+)\s+(minute|hour|day|week)s?\s+ago\s*$", 2))
    minutes = F.when(unit == "minute", 1).when(unit == "hour", 60).when(unit == "day", 1440).when(unit == "week", 10080)
    return F.timestamp_micros(F.unix_micros(as_of) - n * minutes * 60_000_000)
