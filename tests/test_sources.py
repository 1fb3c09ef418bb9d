"""Highlights, cache, timers of jobs and changes of state against plain loops."""

import html
import os
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import caching, highlights, state
from skein.plans import catalog, q_sources
from skein.sources import readers
from skein.streaming import jobs

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")


def span(name, text, flags=""):
    return f'<span data-annotation-id="{name}" data-annotation-color="red"{flags}>{text}</span>'


BOTH = ' data-annotation-start="true" data-annotation-end="true"'


@pytest.mark.parametrize(
    ("text", "block", "marks", "want"),
    [
        ("<p>Hello <em>world</em></p>", (0, 11), [("a", 6, 11, "red")], f"<p>Hello <em>{span('a', 'world', BOTH)}</em></p>"),
        ("<p>a &amp; b</p>", (10, 15), [("a", 12, 13, "red")], f"<p>a {span('a', '&amp;', BOTH)} b</p>"),
        ("<p>one <b>two</b></p>", (0, 7), [("a", 2, 6, "red")], "<p>on" + span("a", "e ", ' data-annotation-start="true"') + "<b>" + span("a", "tw", ' data-annotation-end="true"') + "o</b></p>"),
        ("<p>middle</p>", (100, 106), [("a", 50, 200, "red")], f"<p>{span('a', 'middle')}</p>"),
        ("<p>abc</p>", (0, 3), [("a", 3, 9, "red")], "<p>abc</p>"),
        ("", (0, 0), [], ""),
    ],
)
def test_inject(text, block, marks, want):
    assert highlights.inject(text, *block, marks) == want


def test_inject_nests_later_annotations():
    got = highlights.inject("abcdef", 0, 6, [("b", 2, 6, "red"), ("a", 0, 4, "red")])
    inner = span("b", "cd", ' data-annotation-start="true"')
    assert got == span("a", "ab" + inner, BOTH) + span("b", "ef", ' data-annotation-end="true"')


@given(st.lists(st.text("ab<&> é", max_size=6), max_size=5), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=6))
def test_inject_marks_exactly_the_ranges(parts, ranges):
    whole = "".join(parts)
    page = "".join(f"<i>{html.escape(p)}</i>" for p in parts)
    marks = [(k, s, s + n, "red") for k, (s, n) in enumerate(ranges)]
    got = highlights.inject(page, 0, len(whole), marks)
    assert html.unescape(re.sub("<[^>]*>", "", got)) == whole
    assert {(i, n) for i, _, n, _, _ in highlights.read_marks(got)} == {(str(k), min(e, len(whole)) - s) for k, s, e, _ in marks if s < len(whole)}


def test_highlight_blocks_keeps_blocks_without_marks(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 3, "<p>abc</p>"), (2, 1, 3, 6, None), (3, 2, 0, 3, "xyz")], "id long, document_id long, start_offset int, end_offset int, html string")
    a = spark.createDataFrame([("a", 1, 1, 5, "red")], "annotation_id string, document_id long, start_offset int, end_offset int, color string")
    got = {r["id"]: r["html"] for r in highlights.highlight_blocks(blocks, a).collect()}
    assert got == {1: "<p>a" + span("a", "bc", ' data-annotation-start="true"') + "</p>", 2: None, 3: "xyz"}


def plain_cache(rows, ttl, entries, memory):
    """Lists only: the front is the one used longest ago."""
    kept, out = [], []
    for seq, at, key, size in rows:
        old = [k for k in kept if k[0] == key]
        if old and at - old[0][1] <= ttl:
            kept.remove(old[0])
            kept.append(old[0])
            out.append((seq, True, 0))
            continue
        kept = [k for k in kept if k[0] != key]
        n = 0
        if len(kept) == entries:
            kept, n = kept[1:], 1
        kept.append((key, at, size))
        while sum(k[2] for k in kept) > memory:
            kept, n = kept[1:], n + 1
        out.append((seq, False, n))
    return out


@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abcde"), st.integers(0, 6)), max_size=60))
def test_cache(steps):
    at, rows = 0, []
    for i, (gap, key, size) in enumerate(steps):
        at += gap
        rows.append((i, at, key, size))
    c = caching.Cache(7, 3, 9)
    assert [(i, *c.access(k, t, s)) for i, t, k, s in rows] == plain_cache(rows, 7, 3, 9)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_cache_query(spark):
    class t:
        events = spark.read.parquet(f"{FOLDER}/events.parquet")

    by: dict = {}
    for r in q_sources.cache_accesses(t).collect():
        by.setdefault(str(r["cache"]), []).append((r["seq"], r["at_ms"], r["key"], r["size"]))
    want = {(c, *x) for c, rows in by.items() for x in plain_cache(sorted(rows, key=lambda x: (x[1], x[0])), *q_sources.CACHE.values())}
    got = catalog.queries()["st7_cache"](spark, FOLDER).collect()
    assert {(r["cache"], r["seq"], r["hit"], r["evicted"]) for r in got} == want and len(got) == len(want)
    stats = {r["cache"]: r for r in catalog.queries()["st7_cache_statistics"](spark, FOLDER).collect()}
    for c in by:
        mine = [x for x in want if x[0] == c]
        assert (stats[c]["hits"], stats[c]["misses"], stats[c]["evictions"]) == (sum(x[2] for x in mine), sum(not x[2] for x in mine), sum(x[3] for x in mine))
    assert any(x[2] for x in want) and any(x[3] for x in want)


def plain_timers(rows, until):
    """Minute timers of one job, by looking ahead to the next event. rows: (at, event, status, error), in order; `until`: the last watermark."""
    out, tries = [], 0
    for i, (at, _, status, error) in enumerate(rows):
        out.append((at, status, tries, "event"))
        end = rows[i + 1][0] if i + 1 < len(rows) else until
        if status == "processing" and at + 30 * 60_000_000 <= end:
            out.append((at + 30 * 60_000_000, "pending", tries, "stale"))
        if status == "failed" and error != "disk full" and tries < 3:
            wait = at + [1, 2, 4][tries] * 60_000_000
            if wait <= end:
                tries += 1
                out.append((wait, "pending", tries, "retry"))
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_retry_timers(spark):
    events = q_sources.job_stream(spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("us", F.unix_micros("ts")).collect()
    until = (max(r["us"] for r in events) // 1000 - 3_600_000) * 1000
    by: dict = {}
    for r in events:
        by.setdefault(r["job_id"], []).append((r["us"], r["event_id"], r["status"], r["error"]))
    want = sorted((j, *x) for j, rows in by.items() for x in plain_timers(sorted(rows), until))
    got = sorted(tuple(r[c] for c in ("job_id", "at_us", "status", "retries", "reason")) for r in catalog.queries()["st3_retry_timers"](spark, FOLDER).collect())
    assert got == want
    assert {r[4] for r in got} == {"event", "retry", "stale"}


def test_retry_timers_do_not_depend_on_batches(spark, tmp_path):
    """The same events in one file and in one a batch."""
    rows = [(1, 0, "processing"), (1, 40, "failed"), (1, 50, "failed"), (1, 200, "failed"), (2, 10, "failed"), (2, 10.5, "processing"), (2, 20, "completed"), (3, 900, "pending")]
    schema = "job_id long, ts timestamp, event_id long, status string, error string"
    df = spark.createDataFrame([(j, (1000 + m) * 60.0, i, s) for i, (j, m, s) in enumerate(rows)], "job_id long, s double, event_id long, status string")
    df = df.select("job_id", F.timestamp_seconds("s").alias("ts"), "event_id", "status", F.lit("network timeout").alias("error")).orderBy("ts")
    got = []
    for name, parts in (("one", 1), ("many", 4)):
        df.repartitionByRange(parts, "ts").write.parquet(f"file://{tmp_path}/{name}")
        for k, f in enumerate(sorted((tmp_path / name).glob("part-*"))):
            os.utime(f, (1_700_000_000 + k * 60,) * 2)  # files come in order of their times
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")
        got.append(sorted(map(tuple, jobs.run_once(jobs.job_retries(stream, "800 minutes")).collect())))
    assert got[0] == got[1]
    assert [(r[1] // 60_000_000 - 1000, r[2], r[3], r[4]) for r in got[0] if r[0] == 1 and r[1] <= 1100 * 60_000_000] == [(0, "processing", 0, "event"), (30, "pending", 0, "stale"), (40, "failed", 0, "event"), (41, "pending", 1, "retry"), (50, "failed", 1, "event"), (52, "pending", 2, "retry")]


def test_touched_and_weights(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None)], "id long, x string, y string").withColumn("updated_at", F.lit(0))
    new = spark.createDataFrame([(1, "a", None), (2, "c", None), (3, None, None), (4, "n", None)], "id long, x string, y string")
    assert {r["id"]: r["updated_at"] for r in state.touched(old, new, "id", F.lit(9)).collect()} == {1: 0, 2: 9, 3: 0, 4: 9}
    users = spark.createDataFrame([(i,) for i in range(1, 6)], "user_id long")
    kept = spark.createDataFrame([(1, 0.5, 0.5, "max"), (2, 0.9, 0.1, "max")], "user_id long, p double, q double, method string")
    up = spark.createDataFrame([(2, 3.0, 1.0, None), (3, 0.0, 0.0, "sigmoid"), (4, 0.4, 0.605, None)], "user_id long, p double, q double, method string")
    got = {r["user_id"]: tuple(r)[1:] for r in state.upsert_weights(users, kept, up, ["p", "q"]).collect()}
    assert got == {1: (0.5, 0.5, "max", "kept"), 2: (0.75, 0.25, "max", "updated"), 3: (0.5, 0.5, "sigmoid", "inserted"), 4: (0.4, 0.605, "linear", "inserted"), 5: (0.5, 0.5, "linear", "default")}


def test_vault(spark, tmp_path):
    for name in ("one/content.md", "one/chunks.json", "one/metadata.json", "two/content.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {os.path.basename(r["folder"]): (r["content"], r["chunks"], r["metadata"], r["complete"]) for r in readers.vault(spark, str(tmp_path)).collect()}
    assert got == {"one": (True, True, True, True), "two": (True, False, False, False)}
