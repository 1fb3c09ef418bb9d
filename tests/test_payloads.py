"""Containment in payloads of any shape."""

import re

from pyspark.sql import functions as F

from skein.operators.payloads import PayloadTable, contains_object, extract, variant

PAYLOADS = [
    (1, '{"chunk_ids": [1, 2, 3], "position": {"page": 4, "open": true}, "tags": ["a", "b"]}'), (2, '{"chunk_ids": [2, 3, 3, null], "position": {"page": 4.0}}'), (3, '{"chunk_ids": "2"}'), (4, "{"), (5, None),
    (6, '[2, 3]'), (7, '{"chunk_ids": []}'), (8, '{"other": 1, "chunk_ids": null}'), (9, '{"chunk_ids": [2], "position": {"page": "4"}}'), (9, '{"chunk_ids": [3]}'), (10, ""),
]


def table(spark, path):
    return PayloadTable.build(spark.createDataFrame(PAYLOADS, "id long, payload string"), "$.chunk_ids", "long", f"{path}/t")


def test_elements(spark, tmp_path):
    t = table(spark, tmp_path)
    ids = lambda *v: sorted(r["id"] for r in t.holding(*v).collect())
    assert ids(2) == [1, 2, 9] and ids(2, 3) == [1, 2, 9] and ids(1, 3) == [1] and ids(3, 3) == [1, 2, 9] and ids(7) == ids() == ids(None) == []
    assert sorted(r["id"] for r in t.malformed.collect()) == [4, 10] and sorted(r["id"] for r in t.rows.collect()) == [1, 2, 3, 6, 7, 8, 9, 9]
    s = spark.createDataFrame([("a", [2, 3]), ("b", [1]), ("c", []), ("d", [None]), ("e", [2, 2])], "search string, values array<long>")
    assert sorted(map(tuple, t.contains(s).collect())) == [("a", 1), ("a", 2), ("a", 9), ("b", 1), ("e", 1), ("e", 2), ("e", 9)]


def test_a_search_reads_elements_only(spark, tmp_path):
    t = table(spark, tmp_path)
    found = t.holding(2, 3)
    assert all("/t/elements/" in f for f in found.inputFiles()) and re.search(r"PushedFilters: \[[^\]]*In\(element", found._jdf.queryExecution().toString())


def test_objects(spark):
    d = spark.createDataFrame(PAYLOADS, "id long, payload string").withColumn("v", variant(F.col("payload")))

    def found(wanted):
        return sorted(r["id"] for r in d.where(contains_object(F.col("v"), wanted)).collect())

    assert found({"position": {"page": 4}}) == [1, 2, 9]  # a text that reads as the number counts as it
    assert found({"tags": ["b"]}) == [1] and found({"tags": ["b", "x"]}) == [] and found({"position": {"open": True}}) == [1] and found({"position": {"open": False}}) == []
    assert found({"chunk_ids": None}) == [8] and found({"chunk_ids": [2, 3]}) == [1, 2] and found({}) == sorted(i for i, p in PAYLOADS if p and p != "{")
    got = d.where("id = 1").select(extract(F.col("v"), "$.position.page", "int").alias("p"), extract(F.col("v"), "$.tags", "array<string>").alias("t"), extract(F.col("v"), "$.tags", "int").alias("n")).first()
    assert tuple(got) == (4, ["a", "b"], None)


def test_payloads_are_read_once(spark, tmp_path):
    """However many tables are written of them."""
    said = str(tmp_path / "said")

    def told(frames):
        for f in frames:
            with open(said, "a") as out:
                out.writelines(f"{i}\n" for i in f["id"])
            yield f

    rows = spark.createDataFrame(PAYLOADS, "id long, payload string").repartition(3).mapInPandas(told, "id long, payload string")
    t = PayloadTable.build(rows, "$.chunk_ids", "long", f"{tmp_path}/t")
    assert sorted(map(int, open(said).read().split())) == sorted(i for i, _ in PAYLOADS)
    assert sorted(map(tuple, t.elements.collect())) == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (2, 9, 0), (3, 1, 2), (3, 2, 1), (3, 9, 0)]
    nothing = PayloadTable.build(rows.where("id < 0"), "$.chunk_ids", "long", f"{tmp_path}/n")
    assert nothing.holding(2).count() == nothing.rows.count() == nothing.malformed.count() == 0
