"""Batches that are refused, retried, lost and run twice."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skein.sources import batches as B


def rows_of(*values):
    return pa.RecordBatch.from_pydict({"id": list(values)})


class Listed:
    """A store in memory."""

    def __init__(self, bad=(), flaky=0):
        self.bad, self.flaky, self.rows, self.refused, self.calls = set(bad), flaky, [], [], 0

    def insert(self, session, batch):
        self.calls += 1
        if self.flaky:
            self.flaky -= 1
            raise B.Transient("later")
        ids = batch.column(0).to_pylist()
        if self.bad & set(ids):
            raise B.Refused(f"{sorted(self.bad & set(ids))}")
        self.rows += ids

    def refuse(self, session, row, why):
        self.refused.append((row.column(0).to_pylist()[0], why))


def test_a_bad_row_stands_alone():
    s = Listed(bad=[37])
    B.insert_isolating(s, None, rows_of(*range(100)))
    assert s.rows == [i for i in range(100) if i != 37] and s.refused == [(37, "[37]")] and s.calls <= 2 * 7 + 1
    s = Listed(bad=range(16))
    B.insert_isolating(s, None, rows_of(*range(16)))
    assert s.rows == [] and len(s.refused) == 16 and s.calls == 31


def test_passing_failures_are_tried_again():
    s = Listed(flaky=2)
    B.insert_isolating(s, None, rows_of(1, 2), pause=0)
    assert s.rows == [1, 2] and s.calls == 3
    s = Listed(flaky=4)
    B.insert_isolating(s, None, rows_of(1), retries=3, pause=0)
    assert s.refused == [(1, "gave up after 4 attempts: later")]


def test_sizes():
    assert [B.optimal_size(n, 10) for n in (1, 40, 320, 5000)] == [5, 5, 32, 100] and B.optimal_size(5000, 7000) == 9 and B.batch_rows(100, 70_000) == 1


def refuse_sevens(batch):
    if any(i % 7 == 0 for i in batch.column(0).to_pylist()):
        raise B.Refused("a seven")


def test_write_and_read(spark, tmp_path):
    store = B.FolderStore(f"file://{tmp_path}/store", refuse_sevens)
    df = spark.range(500).withColumn("name", F.concat(F.lit("n"), "id")).repartition(4)
    B.write_batches(df, store, size=20)
    got = B.read_committed(spark, store, df.schema)
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(500) if i % 7]
    failed = B.read_refused(spark, store).collect()
    assert sorted(int(f["row"]["id"]) for f in failed) == [i for i in range(500) if i % 7 == 0] and {f["error"] for f in failed} == {"a seven"}
    assert len(store.committed_files("rows")) <= 4
    sessions = store.published()
    assert sum(s.inserted for s in sessions) == 428 and sum(s.failed for s in sessions) == 72
    B.write_batches(df.where("id < 0"), store)
    B.write_batches(df.where("id = 1"), store)
    assert B.read_committed(spark, store, df.schema).count() == 429  # another write adds to it


def test_a_failed_write_shows_nothing(spark, tmp_path):
    def stumble(batch):
        if 250 in batch.column(0).to_pylist():
            raise OSError("the store is gone")

    store = B.FolderStore(f"file://{tmp_path}/store", stumble)
    with pytest.raises(Exception, match="the store is gone"):
        B.write_batches(spark.range(500).repartition(4), store)
    assert B.read_committed(spark, store, spark.range(1).schema).count() == 0 and store.published() == []


def test_a_killed_task_leaves_no_double_rows(tmp_path):
    """A task's process ends after it has staged rows; the task runs again in a session that allows it."""
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from skein.sources import batches as B
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
mark = {str(tmp_path / "mark")!r}
def die_once(batch):
    ids = batch.column(0).to_pylist()
    if max(ids) >= 90 and not os.path.exists(mark):
        open(mark, "w").close()
        os._exit(1)
store = B.FolderStore({f"file://{tmp_path}/store"!r}, die_once, held=1)
df = spark.range(0, 100, 1, 2)
B.write_batches(df, store, size=10)
print("ROWS", sorted(r["id"] for r in B.read_committed(spark, store, df.schema).collect()) == list(range(100)), len(store._files("rows")) > 10)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ, timeout=240)
    assert "ROWS True True" in said.stdout, said.stderr[-2000:]  # files of the lost attempt are there and do not count
    assert (tmp_path / "mark").exists()


def test_held_batches_are_counted_once(tmp_path):
    """What a batch costs does not grow with the batches that are held."""
    asked = []

    class Counted:
        @property
        def num_rows(self):
            asked.append(1)
            return 1

    store = B.FolderStore(f"file://{tmp_path}/store")
    session = store.open()
    for _ in range(1000):
        store.insert(session, Counted())
    assert len(asked) <= 3000 and session.inserted == 1000


def test_files_hold_as_many_rows_as_asked(tmp_path):
    store = B.FolderStore(f"file://{tmp_path}/store", refuse_sevens, held=10)
    session = store.open()
    for i in range(0, 100, 5):
        B.insert_isolating(store, session, rows_of(*range(i, i + 5)))
    store.close(session)
    store.publish([session])
    assert session.inserted == 85 and session.failed == 15 and session.waiting == 0
    files = [pq.read_table(store._at()[0].open_input_file(f))["id"].to_pylist() for f in store.committed_files("rows")]
    assert sorted(i for f in files for i in f) == [i for i in range(100) if i % 7] and all(len(f) < 15 for f in files)
