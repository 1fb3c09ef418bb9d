"""What a cache with least-recent eviction and expiry does to a log of accesses."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Five minutes, entries and bytes of one cache.
TTL_MS, ENTRIES, BYTES = 300_000, 1000, 50 << 20


class Cache:
    """Keys in order of use, with the time they were put and their size. An entry lives from its put on, however often it is read."""

    def __init__(self, ttl: int = TTL_MS, entries: int = ENTRIES, memory: int = BYTES):
        self.ttl, self.entries, self.memory = ttl, entries, memory
        self.kept: OrderedDict = OrderedDict()
        self.used = 0

    def _evict(self) -> int:
        _, (_, size) = self.kept.popitem(last=False)
        self.used -= size
        return 1

    def access(self, key, now: int, size: int) -> tuple[bool, int]:
        """A read that puts the value on a miss: whether it hit, and how many entries it evicted. An entry too large for the cache evicts all, itself too."""
        entry = self.kept.get(key)
        if entry is not None and now - entry[0] <= self.ttl:
            self.kept.move_to_end(key)
            return True, 0
        if entry is not None:
            del self.kept[key]
            self.used -= entry[1]
        out = self._evict() if len(self.kept) >= self.entries else 0
        self.kept[key] = (now, size)
        self.used += size
        while self.used > self.memory:
            out += self._evict()
        return False, out


def simulate(accesses: DataFrame, ttl: int = TTL_MS, entries: int = ENTRIES, memory: int = BYTES) -> DataFrame:
    """accesses (cache, seq, at_ms, key, size) in order of (at_ms, seq) per cache: seq, hit, evicted, entries and memory after each.

    Rows stream through their task in order, so memory holds one cache's entries, not its log. A cache is one sequence by nature: a busy one is
    one task, and splits only if its keys are dealt to caches of their own. Null sizes count 0; null keys are a key.
    """
    schema = "cache string, seq long, hit boolean, evicted int, entries int, memory long"

    def run(batches):
        name, c = object(), None
        for b in batches:
            rows = []
            for cache, seq, at, key, size in zip(b["cache"], b["seq"], b["at_ms"], b["key"], b["size"], strict=True):
                if cache != name:
                    name, c = cache, Cache(ttl, entries, memory)
                hit, out = c.access(key, at, int(size))
                rows.append((cache, seq, hit, out, len(c.kept), c.used))
            yield pd.DataFrame(rows, columns=["cache", "seq", "hit", "evicted", "entries", "memory"])

    a = accesses.select(F.col("cache").cast("string").alias("cache"), F.col("seq").cast("long").alias("seq"), F.col("at_ms").cast("long").alias("at_ms"), F.col("key").cast("string").alias("key"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    return a.repartition("cache").sortWithinPartitions("cache", "at_ms", "seq").mapInPandas(run, schema)


def statistics(trace: DataFrame) -> DataFrame:
    """hits, misses, evictions and hit rate of each cache; without accesses there is no row."""
    hits, n = F.sum(F.col("hit").cast("long")), F.count("*")
    return trace.groupBy("cache").agg(hits.alias("hits"), (n - hits).alias("misses"), F.sum("evicted").alias("evictions"), (hits / n).alias("hit_rate"))
