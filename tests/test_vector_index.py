"""The inverted-file index against a search of all rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.vector_index import VectorIndex, fit_centres
from skein.operators.vector_search import top_k_cosine
from skein.plans import catalog

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")
ROWS = "id long, document_id long, embedding array<double>"


def pairs(df):
    return {(r["source"], r["target"], r["rank"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16)) * 3
    rows = [(i, i % 40, (centres[i % 20] + r.normal(size=16) * 0.6).tolist()) for i in range(1500)]
    rows += [(i, i % 7, rows[3][2]) for i in range(1500, 2300)]  # a third in one place
    rows += [(3000, 1, [0.0] * 16), (3001, 1, None), (3002, None, rows[5][2])]
    return spark.createDataFrame(rows, ROWS).repartition(5)


def test_recall_and_rows_read(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr("skein.operators.vector_index.LIST_ROWS", 100)  # hot lists in many tiles
    monkeypatch.setattr("skein.operators.vector_index.QUERY_ROWS", 7)
    index = VectorIndex.build(clustered, f"{tmp_path}/ix")
    q = clustered.where("id % 50 = 0")
    every = pairs(top_k_cosine(q, clustered.where("document_id is not null"), 10, 0.3))
    assert pairs(index.search(q, 10, 0.3, exact=True, where="document_id is not null")) == every
    got = pairs(index.search(q, 10, 0.3, where="document_id is not null"))
    hit = {x[:2] for x in got} & {x[:2] for x in every}
    assert len(hit) >= 0.9 * len(every)
    read = index.rows_read(q).agg(F.avg("rows_read")).first()[0]
    assert read < 0.6 * 2301  # clustered vectors need few lists
    assert index.rows().count() == 2301  # all but the zero and the null vector
    one = index.search(q, 10, 0.3, probes=1)
    assert one.count() <= len(every)


def test_only_probed_lists_are_scanned(spark, clustered, tmp_path):
    index = VectorIndex.build(clustered, f"{tmp_path}/ix", lists=12)
    plan = index.rows().where("list in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "[list") or "PartitionFilters" in plan
    again = VectorIndex(spark, f"{tmp_path}/ix")
    assert len(again.centres) == 12 and again.margin == index.margin


def test_odd_tables(spark, tmp_path):
    none = VectorIndex.build(spark.createDataFrame([], ROWS), f"{tmp_path}/none")
    assert none.search(spark.createDataFrame([(1, 1, [1.0, 0.0])], ROWS), 3, 0.0, exact=True).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0, 2.0])], ROWS), f"{tmp_path}/two")
    same = spark.createDataFrame([(i, i, [1.0, 2.0]) for i in range(5)], ROWS)
    index = VectorIndex.build(same, f"{tmp_path}/same")
    assert pairs(index.search(same.where("id = 0"), 3, 0.5)) == {(0, k, k, 1.0) for k in (1, 2, 3)}


def test_centres_are_unit_and_distinct():
    x = np.random.default_rng(1).normal(size=(200, 5))
    c = fit_centres(x, 14)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and len(np.unique(c.round(9), axis=0)) == 14


def test_recall_query(spark):
    rows = catalog.queries()["j1_index_recall"](spark, FOLDER).collect()
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["exact"] for r in rows)
    assert len(rows) == spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 50 = 0").count()


def test_blocks_are_shuffled_once(spark):
    """However many blocks there are, no vector is dealt out for each of them; equal vectors tie, and null documents and zero vectors find nothing."""
    rng = np.random.default_rng(3)
    own = [[float(y) for y in rng.normal(size=8).astype(np.float32)] for _ in range(60)]
    values = [(i, i % 7, own[i % 60]) for i in range(300)] + [(300, None, own[0]), (301, 1, [0.0] * 8), (302, 2, None)]
    df = spark.createDataFrame(values, "id long, document_id long, embedding array<double>")
    out = top_k_cosine(df, df, 4, 0.2, block=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInPandas" not in plan
    got = {(r["source"], r["rank"]): (r["target"], r["similarity"]) for r in out.collect()}
    want = {}
    for i, d, x in values[:300]:
        def cosine(y):
            return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
        near = sorted((-s, j) for j, e, y in values[:300] if e != d and (s := min(1.0, cosine(y))) > 0.2)[:4]
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(near)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
