"""Writing to a store that takes rows in batches and refuses a batch as a whole: a Python data source with commit messages.

`write_batches` hands the rows of a frame to a store, `size` rows at a time and never more values than `parameters`. A batch that fails for a passing
reason (Transient) is tried again; one that is refused is halved until the refused row stands alone, so one bad row costs about log2(size) more
calls and no good row. What a task has inserted becomes visible only by its commit message: the store opens a session for each attempt of a task, a session's
rows are staged, and when all tasks have succeeded the driver publishes the sessions that are named in the messages, at once. An attempt that is lost
or runs twice is in no message: its rows are never seen, and `abort` clears away what it can.

FolderStore is such a store over files (any file system of pyarrow); a client of a database is another with the same methods. `read_committed` reads
what has been published, a file a partition.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PARAMETERS = 65535  # fixed value: most values that one statement may carry


class Transient(RuntimeError):
    """A failure that may pass: the batch is tried again."""


class Refused(ValueError):
    """The store refuses a batch because of some row in it."""


@dataclass
class Session:
    """One attempt of a task: where its rows and refused rows are staged."""

    name: str
    inserted: int = 0
    failed: int = 0
    calls: int = 0
    files: int = 0
    waiting: int = 0  # rows in `rows`: counted as they come, as the batches held may be of one row each
    rows: list = field(default_factory=list)
    lines: list = field(default_factory=list)


@dataclass
class Done(WriterCommitMessage):
    session: Session


class FolderStore:
    """Rows as Parquet files below a folder, refused rows with what was said; `check` sees each batch first and raises Refused or Transient.

    rows/<session>-<n>.parquet and refused/<session>-<n>.json are staged, `held` rows to a file; committed/<publication>.json names the sessions that count.
    """

    def __init__(self, folder: str, check: Callable[[pa.RecordBatch], None] | None = None, held: int = 1 << 16):
        self.folder, self.check, self.held = folder, check, held

    def _at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.folder)
        return fs, "/".join([path.rstrip("/"), *names])

    def open(self) -> Session:
        return Session(uuid.uuid4().hex)

    def insert(self, session: Session, batch: pa.RecordBatch) -> None:
        """Stage a batch, all of it or nothing."""
        session.calls += 1
        if self.check is not None:
            self.check(batch)
        session.rows.append(batch)
        session.inserted += batch.num_rows
        session.waiting += batch.num_rows
        if session.waiting >= self.held:
            self._stage(session)

    def refuse(self, session: Session, row: pa.RecordBatch, why: str) -> None:
        session.lines.append((row, why))
        session.failed += 1
        if len(session.lines) >= self.held:
            self._stage(session)

    def close(self, session: Session) -> None:
        """The end of an attempt: nothing is held back any more."""
        self._stage(session)

    def _stage(self, session: Session) -> None:
        for kind, held, end in (("rows", session.rows, "parquet"), ("refused", session.lines, "json")):
            if held:
                fs, path = self._at(kind, f"{session.name}-{session.files:08d}.{end}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    if kind == "rows":
                        pq.write_table(pa.Table.from_batches(held), out)
                    else:
                        refused = pa.Table.from_batches([row for row, _ in held]).combine_chunks().to_pylist()  # all at once: row by row takes many times as long
                        for values, (_, why) in zip(refused, held, strict=True):
                            out.write((json.dumps({"row": {k: None if v is None else str(v) for k, v in values.items()}, "error": why}) + "\n").encode())
                session.files += 1
                held.clear()
        session.waiting = 0

    def publish(self, sessions: list[Session]) -> None:
        """Make the sessions' rows visible, at once."""
        fs, path = self._at("committed", f"{uuid.uuid4().hex}.json")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{path}.tmp") as out:
            out.write(json.dumps([asdict(s) for s in sessions]).encode())
        fs.move(f"{path}.tmp", path)

    def discard(self, sessions: list[Session]) -> None:
        fs, _ = self._at()
        for kind in ("rows", "refused"):
            for f in self._files(kind):
                if f.rpartition("/")[2].partition("-")[0] in {s.name for s in sessions}:
                    fs.delete_file(f)

    def _files(self, kind: str) -> list[str]:
        fs, path = self._at(kind)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return []
        return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File)

    def published(self) -> list[Session]:
        fs, _ = self._at()
        out = []
        for f in self._files("committed"):
            if f.endswith(".json"):
                with fs.open_input_stream(f) as s:
                    out += [Session(**x) for x in json.loads(s.read())]
        return out

    def committed_files(self, kind: str) -> list[str]:
        names = {s.name for s in self.published()}
        return [f for f in self._files(kind) if f.rpartition("/")[2].partition("-")[0] in names]


def batch_rows(size: int, fields: int, parameters: int = PARAMETERS) -> int:
    return max(1, min(size, parameters // max(1, fields)))


def insert_isolating(store, session: Session, batch: pa.RecordBatch, retries: int = 3, pause: float = 0.1) -> None:
    """Insert a batch; what is refused is halved until rows stand alone."""
    for attempt in range(retries + 1):
        try:
            store.insert(session, batch)
            return
        except Transient as e:
            if attempt == retries:
                why = f"gave up after {retries + 1} attempts: {e}"
                break
            time.sleep(pause * 2**attempt)
        except Refused as e:
            why = str(e)
            break
    if batch.num_rows == 1:
        store.refuse(session, batch, why)
        return
    half = batch.num_rows // 2
    insert_isolating(store, session, batch.slice(0, half), retries, pause)
    insert_isolating(store, session, batch.slice(half), retries, pause)


class _Writer(DataSourceArrowWriter):
    def __init__(self, store, size: int, retries: int):
        self.store, self.size, self.retries = store, size, retries

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        session = self.store.open()
        for batch in iterator:
            rows = batch_rows(self.size, batch.num_columns)
            for i in range(0, batch.num_rows, rows):
                insert_isolating(self.store, session, batch.slice(i, rows), self.retries)
        self.store.close(session)
        return Done(session)

    def commit(self, messages) -> None:
        self.store.publish([m.session for m in messages if m is not None])

    def abort(self, messages) -> None:
        self.store.discard([m.session for m in messages if m is not None])


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, store: FolderStore):
        self.store = store

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.store.committed_files("rows")] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            fs, _ = self.store._at()
            with fs.open_input_file(partition.path) as f:
                yield from pq.read_table(f).to_batches()


def _register(spark: SparkSession, store, size: int, retries: int) -> str:
    """A data source of its own over the store; its name."""
    own = f"batches_{uuid.uuid4().hex}"

    class Batches(DataSource):
        @classmethod
        def name(cls):
            return own

        def writer(self, schema: StructType, overwrite: bool):
            return _Writer(store, size, retries)

        def reader(self, schema: StructType):
            return _Reader(store)

    spark.dataSource.register(Batches)
    return own


def write_batches(rows: DataFrame, store, size: int = 100, retries: int = 3) -> None:
    """Append the rows to the store, once, whatever becomes of single tasks."""
    rows.write.format(_register(rows.sparkSession, store, size, retries)).mode("append").save()


def read_committed(spark: SparkSession, store: FolderStore, schema: StructType) -> DataFrame:
    """What has been published."""
    return spark.read.format(_register(spark, store, 1, 0)).schema(schema).load()


def read_refused(spark: SparkSession, store: FolderStore) -> DataFrame:
    """row (its values as text) and error of what committed tasks were refused."""
    scheme = store.folder.partition("://")[0] + "://" if "://" in store.folder else ""
    schema = "row map<string,string>, error string"
    files = [scheme + f for f in store.committed_files("refused")]  # a few for each task
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def optimal_size(n: int, fields: int) -> int:
    """A tenth of n rows, 5 to 100, and no more than fit in one statement."""
    return batch_rows(min(max(math.ceil(n / 10), 5), 100), fields)
