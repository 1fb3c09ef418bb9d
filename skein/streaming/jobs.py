"""Streams over events: job states, windows, retries and stale jobs."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.snapshots import BUCKETS, SnapshotTable
from ..sources.storage import scratch

STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


def read_events(spark: SparkSession, path: str, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A folder or file of events as a stream, with the schema that is there; batches by size, so that many small files are not as many batches."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).option("recursiveFileLookup", "true").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling windows by event time and type; rows later than `late` behind the newest are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Session windows per user."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def job_states(events: DataFrame) -> DataFrame:
    """The latest status of each job, by (ts, event_id), kept as state across batches; a row for each job that a batch touches.

    An aggregation, so that no key reaches Python: nearly every event may be a job of its own. updated_us counts from the wall clock of the session's zone.
    """
    jobs = events.select((F.col("user_id") * 100000 + F.floor(F.col("event_id") / 5)).alias("job_id"), "ts", "event_id", F.expr(STATUS).alias("status"))
    g = jobs.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("newest"), F.count("*").alias("events"))
    wall = F.from_utc_timestamp("newest.ts", F.current_timezone())
    return g.select("job_id", F.col("newest.status").alias("status"), F.unix_micros(wall).alias("updated_us"), "events")


#: Minutes without a sign of life after which a running job is taken back, and retries of a failed one.
STALE_MINUTES, MOST_RETRIES = 30, 3
#: A failure that says one of these is tried again.
TRANSIENT = ("temporary", "timeout", "network")
_MINUTE = 60_000_000


class JobTimers:
    """One job: its status, retries so far, the timer that runs (microseconds, -1 for none) and the newest change seen."""

    def __init__(self, status: str = "", retries: int = 0, timer: int = -1, at: int = -1, event: int = -1):
        self.status, self.retries, self.timer, self.at, self.event = status, retries, timer, at, event

    def due(self, now: int):
        """What the timer does up to `now`: a failed job waits again, with one more retry; a silent one is taken back. Both then have no timer."""
        if 0 <= self.timer <= now:
            failed = self.status == "failed"
            self.retries += failed
            self.at, self.event, self.timer, self.status = self.timer, -1, -1, "pending"
            yield self.at, self.status, self.retries, "retry" if failed else "stale"

    def event_at(self, at: int, event: int, status: str, error: str | None):
        """An event; older than the newest one (or than a timer that has fired) it counts for nothing."""
        if (at, event) <= (self.at, self.event):
            return
        yield from self.due(at)
        self.at, self.event, self.status, self.timer = at, event, status, -1
        if status == "processing":
            self.timer = at + STALE_MINUTES * _MINUTE
        elif status == "failed" and self.retries < MOST_RETRIES and any(w in (error or "").lower() for w in TRANSIENT):
            self.timer = at + min(2**self.retries, 30) * _MINUTE
        yield at, status, self.retries, "event"


def job_retries(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of jobs (job_id, ts, event_id, status, error) as a stream to every change of a job: job_id, at_us, status, retries, reason.

    Timers run on event time: a transient failure is pending again after 2^retries minutes, 30 at most and MOST_RETRIES times; a job that is
    processing and silent for STALE_MINUTES is pending again. A timer that is due before the next event acts at its own time, whether the
    watermark or that event comes first, so results do not depend on how events are cut into batches. Timers beyond the watermark wait.
    """

    def update(key, batches, state: GroupState):
        job = JobTimers(*state.get) if state.exists else JobTimers()
        if state.hasTimedOut:
            out = list(job.due(state.getCurrentWatermarkMs() * 1000))
        else:
            rows = [(int(pd.Timestamp(ts).value // 1000), int(e), s, x) for b in batches for ts, e, s, x in zip(b["ts"], b["event_id"], b["status"], b["error"], strict=True)]
            out = [r for row in sorted(rows, key=lambda r: r[:2]) for r in job.event_at(*row)]
        state.update((job.status, job.retries, job.timer, job.at, job.event))
        if job.timer >= 0:
            state.setTimeoutTimestamp(max(-(-job.timer // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["job_id", "at_us", "status", "retries", "reason"])

    rows = jobs.withWatermark("ts", late).select("job_id", "ts", "event_id", "status", "error")
    return rows.groupBy("job_id").applyInPandasWithState(update, "job_id long, at_us long, status string, retries int, reason string", "status string, retries int, timer long, at long, event long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Everything that is there now, appended to a Parquet folder exactly once; the result as a table."""
    base = scratch(stream.sparkSession, "stream")
    out = path or f"{base}/out"
    w = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    w.format("parquet").option("path", out).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


#: State on the executors' disks, with a bound on memory, as there may be a key for nearly every event.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries that are started within keep their state so; a query's settings are fixed when it starts."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_once(stream: DataFrame, keys: list[str], order: str, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Everything that a stream of updates says now, the newest row of each key, in a snapshot table: each batch is upserted, nothing is kept on the driver."""
    spark = stream.sparkSession
    base = folder or scratch(spark, "snapshot")
    table = SnapshotTable(spark, f"{base}/table", stream.schema, keys, order, buckets)
    with state_on_disk(spark):
        query = table.follow(stream, "updates", f"{base}/state", mode="update")
    query.awaitTermination()
    return table.read()
