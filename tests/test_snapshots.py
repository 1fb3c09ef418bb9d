"""The snapshot table: versions, conflicts, lost writers, streams that run again."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.sources.snapshots import Conflict, SnapshotTable
from skein.streaming import jobs

SCHEMA = "k long, name string, at long"


def table(spark, path, **options):
    return SnapshotTable(spark, f"file://{path}/t", StructType.fromDDL(SCHEMA), ["k"], "at", **{"buckets": 4} | options)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def all_rows(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert all_rows(t) == [] and t.version() == 0
    assert t.upsert(rows(spark, (1, "a", 1), (2, "b", 1), (None, "n", 1), (1, "older", 0))) == 1
    assert set(map(tuple, t.read().collect())) == {(1, "a", 1), (2, "b", 1), (None, "n", 1)}


def test_upserts_equal_a_loop(spark, tmp_path):
    r = random.Random(2)
    t, want = table(spark, tmp_path), {}
    for at in range(4):
        new = [(r.randrange(30), f"v{at}", r.randrange(3)) for _ in range(12)]
        t.upsert(rows(spark, *new))
        for k, name, when in new:
            want[k] = max(want.get(k, (k, "", -1)), (k, name, when), key=lambda x: (x[2], x))
    assert all_rows(t) == sorted(want.values()) and t.version() == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.upsert(rows(spark, *[(i, "a", 1) for i in range(100)]))
    before = t.pointer()["buckets"]
    t.upsert(rows(spark, (7, "b", 2)))
    after = t.pointer()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 16
    assert (7, "b", 2) in all_rows(t) and len(all_rows(t)) == 100


def test_old_versions_roll_back_and_vacuum(spark, tmp_path):
    t = table(spark, tmp_path)
    for at in range(3):
        t.upsert(rows(spark, (1, f"v{at}", at), (at + 10, "x", at)))
    assert all_rows(t, 1) == [(1, "v0", 0), (10, "x", 0)]
    assert t.roll_back(1) == 4 and all_rows(t) == all_rows(t, 1)
    assert t.overwrite(rows(spark, (5, "only", 1))) == 5 and all_rows(t) == [(5, "only", 1)]
    assert t.vacuum(keep=1) >= 3 and all_rows(t) == [(5, "only", 1)]
    with pytest.raises(ValueError):
        t.read(1)
    assert t.vacuum() == 0


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 1)))
    with monkeypatch.context() as m:
        m.setattr(t.files, "replace", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.upsert(rows(spark, (1, "b", 2)))
    assert all_rows(t) == [(1, "a", 1)] and t.version() == 1
    assert t.upsert(rows(spark, (1, "c", 3))) == 3 and all_rows(t) == [(1, "c", 3)]  # number 2 stays claimed
    assert t.vacuum(keep=1) >= 2 and all_rows(t) == [(1, "c", 3)]


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.upsert(rows(spark, (1, "a", 1)))
    old = a.pointer()
    b.upsert(rows(spark, (2, "b", 1)))
    monkeypatch.setattr(a, "pointer", lambda: old, raising=False)
    with pytest.raises(Conflict):
        monkeypatch.setattr(a, "version", lambda: b.version())
        a.upsert(rows(spark, (3, "c", 1)))
    assert all_rows(b) == [(1, "a", 1), (2, "b", 1)]


def test_a_batch_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    add = lambda both: both.groupBy("k").agg(F.max("name").alias("name"), F.sum("at").alias("at"))
    for batch in (0, 0, 1, 1, 0):
        t.upsert(rows(spark, (1, "a", 10)), "s", batch, merge=add)
    assert all_rows(t) == [(1, "a", 20)]  # sums would tell a batch that ran again
    t.upsert(rows(spark, (1, "a", 1)), "other", 0, merge=add)
    assert all_rows(t) == [(1, "a", 21)]


def test_stream_that_is_replayed(spark, tmp_path):
    r = random.Random(5)
    for i in range(5):
        rows(spark, *[(r.randrange(8), f"f{i}", i * 10 + n) for n in range(6)]).write.parquet(f"{tmp_path}/in/{i}")
    every = spark.read.option("recursiveFileLookup", "true").schema(SCHEMA).parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    t = table(spark, tmp_path)
    t.follow(stream(), "s", f"{tmp_path}/state").awaitTermination()
    want = {}
    for x in every.collect():
        want[x["k"]] = max(want.get(x["k"], (0, "", -1)), tuple(x), key=lambda v: (v[2], v))
    assert all_rows(t) == sorted(want.values())
    version = t.version()
    t.follow(stream(), "s", f"{tmp_path}/state2").awaitTermination()  # all batches again: their numbers are known
    assert t.version() == version and all_rows(t) == sorted(want.values())


def test_latest_once(spark, tmp_path):
    for i in range(3):
        rows(spark, (1, "x", i), (i + 5, "y", i)).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = jobs.latest_once(stream.groupBy("k").agg(F.max("at").alias("at"), F.count("*").alias("n")), ["k"], "n", f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3), (5, 0, 1), (6, 1, 1), (7, 2, 1)]


def test_job_states_of_many_files(spark, tmp_path):
    """A job for nearly every event and many small files: one batch, no key in Python, each job's newest status."""
    rng = random.Random(9)
    kinds = ["signup", "view", "click", "purchase", "error"]
    events = [(i, rng.randrange(40), rng.choice(kinds), i // 90) for i in range(120)]
    for k in range(12):
        part = spark.createDataFrame(events[k::12], "event_id long, user_id long, event_type string, at long").select("event_id", "user_id", "event_type", F.timestamp_seconds("at").alias("ts"))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = jobs.job_states(jobs.read_events(spark, f"{tmp_path}/in"))
    assert "InPandas" not in stream._jdf.queryExecution().analyzed().toString()
    got = jobs.latest_once(stream, ["job_id"], "events", f"file://{tmp_path}/out")
    status = dict(zip(kinds, ["pending", "processing", "paused", "completed", "failed"], strict=True))
    want = {}
    for i, user, kind, at in events:
        old = want.get(user * 100000 + i // 5, ((-1, -1, ""), 0))
        want[user * 100000 + i // 5] = max(old[0], (at * 1_000_000, i, status[kind])), old[1] + 1
    assert sorted(map(tuple, got.collect())) == sorted((k, x[2], x[0], n) for k, (x, n) in want.items())
    assert len(list((tmp_path / "out" / "table" / "history").glob("*.json"))) == 1
