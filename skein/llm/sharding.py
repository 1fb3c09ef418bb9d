"""Sharding by extendible hashing (Fagin et al. 1979).

A document's key is a 60-bit hash of its id. The directory starts as one bucket; only a bucket over `limit` bytes splits, on the next bit of
the hash, until every shard fits. Sizes are summed once for all prefixes of a fine depth (one row a cell, summed before the shuffle)
and rolled up to all shorter prefixes; a shard is the shortest prefix that fits. Only the documents of cells that are still too large
are summed again, eight bits deeper. The directory stays a table; nothing is gathered on the driver but counts.

Defined results: null text: 0 bytes. A bucket whose documents all have one hash (one document over the limit, or rows that repeat an id)
cannot split: it ends where it stands alone, with `fits` false. Null ids hash as the empty text. Empty table: no rows. Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BITS = 60


def shards(spark: SparkSession, docs: DataFrame, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, depth (bits used), shard (their value), shard_docs, shard_bytes, fits."""
    tmp = Scratch(spark)
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    keyed = tmp.write(docs.select(F.col(id_col), key.alias("h"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes")))
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    top, fine = 0, min(BITS, max(4, math.ceil(math.log2(total / limit + 1)) + 4))
    left, done = keyed, None
    while True:
        # cells of `fine` bits, rolled up to prefixes of top..fine bits
        cells = left.groupBy(F.shiftright("h", BITS - fine).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("h1"), F.max("h").alias("h2"))
        cells = tmp.write(cells)
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(fine)))).withColumn("shard", F.expr(f"shiftright(cell, {fine} - depth)"))
        sizes = up.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("h1").alias("h1"), F.max("h2").alias("h2"))
        ends = sizes.where((F.col("shard_bytes") <= limit) | (F.col("h1") == F.col("h2")))
        leaf = up.select("cell", "depth", "shard").join(ends.select("depth", "shard", "shard_bytes", "shard_docs"), ["depth", "shard"])
        leaf = leaf.groupBy("cell").agg(F.min_by(F.struct("depth", "shard", "shard_docs", "shard_bytes"), "depth").alias("leaf"))
        leaf = tmp.write(leaf)
        found = left.withColumn("cell", F.shiftright("h", BITS - fine)).join(leaf, "cell").select(id_col, "n_bytes", "leaf.*")
        done = found if done is None else done.unionByName(found)
        if fine == BITS or leaf.count() == cells.count():
            break
        left = left.withColumn("cell", F.shiftright("h", BITS - fine)).join(leaf.select("cell"), "cell", "left_anti").drop("cell")
        top, fine = fine + 1, min(BITS, fine + 8)
    return done.withColumn("fits", F.col("shard_bytes") <= limit)


def directory(sharded: DataFrame) -> DataFrame:
    """The directory of shards(): one row a shard: depth, shard (the value of the first `depth` bits), first and last hash, docs, bytes, fits."""
    out = sharded.select("depth", "shard", "shard_docs", "shard_bytes", "fits").distinct()
    first = F.expr(f"shiftleft(shard, {BITS} - depth)")
    return out.select("depth", "shard", first.alias("first_hash"), (first + F.expr(f"shiftleft(1L, {BITS} - depth)") - 1).alias("last_hash"), "shard_docs", "shard_bytes", "fits")
