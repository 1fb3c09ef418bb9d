"""Helpers shared by the operators: scratch tables, size-checked joins, word hashing and connected components."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of ids (8 bytes each) up to which a side is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000

M64 = (1 << 64) - 1
MULT = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- scratch tables

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where that is unset, a folder of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = spark.sparkContext.getCheckpointDir()
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


class Scratch:
    """Tables written under the shared folder. Cuts lineage: a lost executor costs a reread, not a recomputation.

    drop() and finish() remove tables that no lazy result reads any more; the rest go when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}", 0
        _open.append(self)
        if len(_open) == 1:
            atexit.register(close_all)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._scratch_path)

    def finish(self, df: DataFrame) -> DataFrame:
        """df written; all tables before it removed."""
        old = range(1, self.n + 1)
        out = self.write(df)
        for k in old:
            self._delete(f"{self.root}/{k}")
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at interpreter exit
            pass


_open: list[Scratch] = []


def close_all(*, but: Scratch | None = None) -> None:
    """Remove the tables of all operators (of one application): for callers whose results are written elsewhere."""
    for s in [s for s in _open if s is not but]:
        s.close()
        _open.remove(s)


def small_rows(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; counts no further."""
    return df.limit(most + 1).count() <= most


def semi_join(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df's rows whose key is in ids (distinct, one column): by broadcast if ids are few (counted), else by shuffle."""
    ids = ids.select(on)
    return df.join(F.broadcast(ids) if small_rows(ids, most) else ids, on, "left_semi")


def crc_mod(col: str, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


# ---------------------------------------------------------------- hashing of words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(9, 14)]] = False
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the words' starts and ends there, and for each text the number of its first word (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    step = np.diff(_IS_WORD[buf].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return buf, starts, ends, np.searchsorted(starts, at)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased on request; depends on the word alone."""
    n = len(starts)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    size = ends - starts
    for i in np.flatnonzero(size > LONG_WORD):
        w = buf[starts[i]:ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((_LOWER[w] if lower else w).tobytes(), digest_size=8).digest(), "little")
    table = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    table = table[_LOWER] if lower else table
    i = 0
    while i < n:  # words of up to SPAN bytes at a time
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        if b[-1] <= SPAN:  # else one very long word, done above
            up, back = _powers()
            sums = np.zeros(int(b[-1]) + 1, np.uint64)
            np.cumsum(table[buf[starts[i]:ends[j - 1]]] * back[:b[-1]], out=sums[1:])
            h = mix(((sums[b] - sums[a]) * up[b - 1]) ^ (size[i:j].astype(np.uint64) << np.uint64(56)))
            short = size[i:j] <= LONG_WORD
            out[i:j][short] = h[short]
        i = j
    return out


SPAN = 1 << 16
_power_table: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULT and of its inverse modulo 2^64."""
    if not _power_table:
        _power_table.extend(np.cumprod(np.concatenate([[np.uint64(1)], np.full(SPAN, x, np.uint64)]), dtype=np.uint64) for x in (MULT, np.uint64(pow(int(MULT), -1, 1 << 64))))
    return _power_table[0], _power_table[1]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (fewer words: the whole sequence as one; none: none), and where each text's begin."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    total = len(words)
    out = np.zeros(begin[-1], np.uint64)
    if total >= k:
        h = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            h = (h + words[j:total - k + 1 + j]) * MULT
            h ^= h >> np.uint64(29)
        of = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(of)) - begin[of] + first[of]
        full = n[of] >= k
        out[full] = mix(h[at[full]])
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(int(n[i]))
        for w in words[first[i]:first[i + 1]]:
            h = np.uint64((int(h) * 0x9FB21C651E98DF25 + int(w)) & M64)
        out[begin[i]] = mix(np.array([h], np.uint64))[0]
    return out, begin


# ---------------------------------------------------------------- batches

#: Bytes of text that a Python worker takes from a batch at a time.
SLICE_BYTES = 2 << 20


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row has."""
    out = np.full(batch.num_rows, 8 * batch.num_columns, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            out += np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
        elif pa.types.is_list(c.type):
            out += 8 * np.asarray(pc.fill_null(pc.list_value_length(c), 0), np.int64)
    return out


def sliced(batches, most: int = SLICE_BYTES):
    """The rows of the batches in runs of about so many bytes (one row at least); afterwards freed memory goes back to the system."""
    for batch in batches:
        end = np.cumsum(row_bytes(batch))
        i = 0
        while i < batch.num_rows:
            done = end[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(end, done + most, "right")))
            yield batch.slice(i, j - i)
            i = j
    release()


def release() -> None:
    """Give freed memory back: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks_of(texts: list[bytes], most: int = 1 << 20):
    """Cut a list of texts into runs of about so many bytes: (from, to)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


# ---------------------------------------------------------------- links

class Forest:
    """Union-find over small local numbers; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every end of the edges (a, b): component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step keeps connectivity, needs two joins whose
    hot keys AQE can split, and adds no more edges than there are. Each round is written to the shared folder. Rounds grow
    with the logarithm of the longest path.
    """
    e = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def few(df: DataFrame, rows: int) -> DataFrame:
        return df.coalesce(max(4, rows // 100_000))  # small results need few files

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(e)
    if not before[0]:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = scratch.write(few(small, before[0]))
        now = mark(new)
        scratch.drop(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))


# ---------------------------------------------------------------- ranks

def numbered(scratch: Scratch, df: DataFrame, order: list, name: str = "g") -> DataFrame:
    """df with `name`: 0, 1, ... in the order given, which must tell all rows apart that differ. Written to the shared folder.

    One range-partitioned sort; a row's number is its place in its partition plus the sizes of the partitions before. Only one row for
    each partition takes part in the window sum. Rows come back in any order.
    """
    from pyspark.sql import Window

    s = scratch.write(df.sort(*order).withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_mid", 33))
    parts = s.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return s.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_before")


def ranked(scratch: Scratch, df: DataFrame, group: str, order: list) -> DataFrame:
    """df with `rank`: 1, 2, ... within each value of `group` (nulls last, one group) in the order given.

    A row's rank is its number among all rows (numbered) less the least number of its group, which is aggregated before the shuffle; neither a
    group nor the list of groups is gathered in one task.
    """
    g = numbered(scratch, df, [F.col(group).asc_nulls_last(), *order], "_g")
    first = scratch.write(g.groupBy(F.col(group).alias("_key")).agg(F.min("_g").alias("_first")))
    return g.join(F.broadcast(first) if small_rows(first, BROADCAST_ROWS // 5) else first, g[group].eqNullSafe(first["_key"])).withColumn("rank", F.col("_g") - F.col("_first") + 1).drop("_g", "_key", "_first")
