"""Breakers, batches that adapt and the chain against a sequential loop."""

import os

import pytest
from pyspark.sql import functions as F

from skein.operators.fallback import Breaker, Chain, answer_rows
from skein.plans import catalog, q_sources

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")


def test_breaker():
    b = Breaker(failures=2, rest=3)
    assert b.allows()
    b.failed_once()
    b.succeeded()
    b.failed_once()
    assert b.state == "closed" and b.allows()
    b.failed_once()
    assert b.state == "open" and [b.allows() for _ in range(3)] == [False] * 3
    assert b.allows() and b.state == "half open"
    b.failed_once()
    assert b.state == "open" and [b.allows() for _ in range(4)] == [False, False, False, True]
    b.succeeded()
    assert b.state == "closed"


def shout(texts):
    if any("bad" in t for t in texts):
        raise RuntimeError("bad text")
    return [t.upper() if len(t) < 12 else None for t in texts]


def count(texts):
    return [str(len(t)) if "none" not in t else None for t in texts]


def test_sizes_and_provenance():
    c = Chain([("shout", shout), ("count", count)], size=4, most=8, step=2)
    got = c.batch(["a", "a longer text", "none of this at all", "b"])
    assert [(g.answer, g.model, g.asked) for g in got] == [("A", "shout", 1), ("13", "count", 2), (None, None, 2), ("B", "shout", 1)]
    assert got[2].errors == ["shout: no answer", "count: no answer"] and c.size == 6
    got = c.batch(["bad", "x"])
    assert [(g.answer, g.model) for g in got] == [("3", "count"), ("1", "count")] and got[1].errors == ["shout: bad text"] and c.size == 3
    for _ in range(2):
        c.batch(["bad"])
    assert c.breakers["shout"].state == "open" and c.size == 1
    assert c.batch(["fine"])[0].errors == ["shout: passed over"]
    wrong = Chain([("short", lambda t: []), ("count", count)])
    assert wrong.batch(["x"])[0].errors == ["short: 0 answers for 1 texts"]


def loop(rows, models, **options):
    chain, out = Chain(models, **options), []
    for (key, _), a in chain.run(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        out.append((key, a.answer, a.model, a.asked, a.errors))
    return out


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_equals_a_sequential_loop_however_batches_are_cut(spark, cut):
    rows = [(i, ("bad " if 40 <= i < 90 or i % 37 == 0 else "") + ("none " if i % 11 == 0 else "") + "text" * (i % 5)) for i in range(400)] + [(None, "x"), (7, "again")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(cut))
    got = answer_rows(spark.createDataFrame(rows, "id long, text string").repartition(5), "id", "text", [("shout", shout), ("count", count)], lane_rows=10_000, size=8).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = loop(rows, [("shout", shout), ("count", count)], size=8)
    assert sorted((tuple(r[c] for c in ("id", "answer", "model", "asked", "errors")) for r in got), key=str) == sorted(want, key=str)
    assert {r["model"] for r in got} == {"shout", "count", None} and any("passed over" in e for r in got for e in r["errors"])


def test_lanes(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("t"), "id").alias("text"))
    got = answer_rows(rows, "id", "text", [("count", count)], lane_rows=50)
    assert got.select("lane").distinct().count() == 6 and got.where("model = 'count'").count() == 300
    assert answer_rows(rows.where("id < 0"), "id", "text", [("count", count)]).count() == 0


def test_query(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = catalog.queries()["enr2_breaker_chain"](spark, FOLDER).collect()
    assert {r["lane"] for r in got} == {0}  # one lane at this size
    want = {k: (a, m, n, len(e)) for k, a, m, n, e in loop(docs, q_sources.MODELS)}
    assert {r["doc_id"]: (r["answer"], r["model"], r["asked"], r["errors"]) for r in got} == want
    assert {r["model"] for r in got} == {"large", "small", "rules"}
