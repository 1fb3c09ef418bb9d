"""Comparing object storage with tables, and sizes of batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sync_state(storage: DataFrame, table: DataFrame) -> DataFrame:
    """Both (id, size): healthy, out_of_sync, missing_from_db or missing_from_storage."""
    s, d = storage.select("id", F.col("size").alias("s")), table.select("id", F.col("size").alias("d"))
    state = F.when(F.col("d").isNull(), "missing_from_db").when(F.col("s").isNull(), "missing_from_storage").when(F.col("s") == F.col("d"), "healthy").otherwise("out_of_sync")
    return s.join(d, "id", "full").select("id", state.alias("state"))


def batch_size(n: Column, fields: int, parameters: int = 65535) -> Column:
    """A tenth of n rows, 5 to 100, and no more than fit in one statement's parameters."""
    return F.least(F.greatest(F.least(F.ceil(n / 10), F.lit(100)), F.lit(5)), F.lit(parameters // fields)).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; in local mode, where that is unset, a temporary one."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='skein-')}/{name}-{uuid.uuid4().hex}"
