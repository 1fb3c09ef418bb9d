"""A table that changes as a whole: rows in buckets by key, a folder for what each version wrote, and one pointer file.

    rows/v<version>-<random>/bucket=<n>/   what a version wrote; never changed afterwards
    history/<version>.json                 the claim on a version number, made by exactly one writer
    current.json                           the pointer: version, the folder that holds each bucket, and the last batch of each stream

A change writes the buckets that it touches to a new folder, claims the next number by creating its history file, which only one writer can, and then
replaces the pointer by one atomic rename. Readers follow the pointer, so they see a version or the next one, never a mixture. A writer that is lost
before the rename leaves the old version in force and files that `vacuum` removes; one that is lost after its claim leaves a number that is skipped.
A streaming batch carries its number: one that has been applied before changes nothing.

Spark writes and reads all rows; the driver handles the pointer, which has a line for each bucket, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has claimed the version."""


class Files:
    """The few file operations on small files, by Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def read(self, path: str) -> str | None:
        p = self._path(path)
        fs = p.getFileSystem(self.conf)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        p = self._path(path)
        try:
            out = p.getFileSystem(self.conf).create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace(self, source: str, target: str) -> None:
        """Rename source to target, which it takes the place of."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        s, t = self._path(source), self._path(target)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(s.getFileSystem(self.conf).getUri(), self.conf).rename(s, t, options)

    def delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.conf).delete(p, True)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        fs = p.getFileSystem(self.conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class SnapshotTable:
    """keys tell rows apart; order: of rows with equal keys the one of the largest counts (null least)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), schema, keys, order, buckets
        self.files = Files(spark)

    # ------------------------------------------------------------ reading

    def pointer(self) -> dict:
        text = self.files.read(f"{self.folder}/current.json")
        return json.loads(text) if text else {"version": 0, "buckets": {}, "batches": {}}

    def version(self) -> int:
        return self.pointer()["version"]

    def _of(self, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/rows/{v}/bucket={b}" for b, v in pointer["buckets"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the version in force, or of an earlier one that has not been vacuumed."""
        if version is None:
            return self._of(self.pointer())
        text = self.files.read(f"{self.folder}/history/{version:020d}.json")
        if text is None:
            raise ValueError(f"no version {version}")
        return self._of(json.loads(text))

    # ------------------------------------------------------------ changing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commit(self, before: dict, changed: DataFrame, touched: list[int], stream: str | None, batch: int | None) -> int:
        version, name = before["version"] + 1, None
        while self.files.read(f"{self.folder}/history/{version:020d}.json") is not None:
            if self.version() >= version:
                raise Conflict(f"version {version} has been written meanwhile")
            version += 1  # claimed by a writer that was lost
        if touched:
            name = f"v{version}-{uuid.uuid4().hex[:8]}"
            spread = changed.select(*self.schema.names, self._bucket().alias("bucket")).repartition("bucket")
            spread.write.partitionBy("bucket").parquet(f"{self.folder}/rows/{name}")
        written = {int(n.partition("=")[2]) for n in self.files.names(f"{self.folder}/rows/{name}") if n.startswith("bucket=")} if name else set()
        buckets = {b: v for b, v in before["buckets"].items() if int(b) not in touched} | {str(b): name for b in sorted(written)}
        after = {"version": version, "buckets": buckets, "batches": before["batches"] | ({stream: batch} if stream is not None else {})}
        text = json.dumps(after, indent=0)
        if not self.files.create(f"{self.folder}/history/{version:020d}.json", text):
            raise Conflict(f"version {version} has been written meanwhile")
        if self.pointer()["version"] != before["version"]:
            raise Conflict(f"version {before['version']} is no longer in force")
        temporary = f"{self.folder}/.current-{uuid.uuid4().hex}"
        self.files.create(temporary, text)
        self.files.replace(temporary, f"{self.folder}/current.json")
        return version

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the largest by order, of equals the largest by all columns."""
        every = F.struct(*self.schema.names)
        return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(F.max_by(every, F.struct(self.order, every)).alias("row")).select("row.*")

    def overwrite(self, rows: DataFrame) -> int:
        """Replace all rows; returns the version."""
        before = self.pointer()
        return self._commit(before, self._latest(rows.select(*self.schema.names)), list(range(self.buckets)), None, None)

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None, merge=None) -> int:
        """Insert rows, or replace those of equal keys that are not newer; only buckets that rows fall into are read and written. Returns the version.

        stream and batch: a batch whose number is not above the stream's last one changes nothing.
        merge: for rows that add to each other instead, a function from all rows of the touched buckets and the new ones to one row for each key.
        """
        before = self.pointer()
        if stream is not None and before["batches"].get(stream, -1) >= batch:
            return before["version"]
        rows = rows.select(*self.schema.names)
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most `buckets`
        both = self._of(before, touched).unionByName(rows)
        return self._commit(before, (merge or self._latest)(both), touched, stream, batch)

    def roll_back(self, version: int) -> int:
        """Put an earlier version's rows in force again, as a version of its own."""
        text = self.files.read(f"{self.folder}/history/{version:020d}.json")
        if text is None:
            raise ValueError(f"no version {version}")
        before, old = self.pointer(), json.loads(text)
        return self._commit({**before, "buckets": old["buckets"]}, self.spark.createDataFrame([], self.schema), [], None, None)

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that none of the last `keep` versions reads; returns how many. Writers must not be at work."""
        now = self.version()
        used = set(self.pointer()["buckets"].values())
        history = self.files.names(f"{self.folder}/history")
        for n in history:
            number = int(n.partition(".")[0])
            if now - keep < number <= now:
                used |= set(json.loads(self.files.read(f"{self.folder}/history/{n}"))["buckets"].values())
            elif number <= now - keep:
                self.files.delete(f"{self.folder}/history/{n}")
        gone = [n for n in self.files.names(f"{self.folder}/rows") if n not in used]
        for n in gone:
            self.files.delete(f"{self.folder}/rows/{n}")
        return len(gone)

    # ------------------------------------------------------------ streams

    def follow(self, stream: DataFrame, name: str, checkpoint: str, merge=None, mode: str = "append"):
        """Start upserting a stream into the table, a version a batch; the query runs to the end of what is there. A batch that runs again changes nothing."""
        def apply(rows: DataFrame, batch: int) -> None:
            rows = rows.persist()  # else each action below works the batch out again, its state with it
            try:
                if not rows.isEmpty():
                    self.upsert(rows, name, batch, merge)
            finally:
                rows.unpersist()

        return stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
