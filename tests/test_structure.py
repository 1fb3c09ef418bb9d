"""The similarity join of structures against all pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skein.operators.chunking import fingerprint, fingerprint_similarity
from skein.operators.structure import similar_structures
from skein.plans import catalog

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")
PRINTS = "id long, sequence array<string>, depth int, complexity double"


def all_pairs(prints, threshold):
    first = {}
    for i, f in sorted(prints):
        first.setdefault((tuple(f["sequence"]), f["depth"]), (i, f))
    own = sorted(first.values(), key=lambda x: x[0])
    out = {}
    for k, (i, f) in enumerate(own):
        for j, g in own[k + 1:]:
            s = fingerprint_similarity(f, g)
            if s >= threshold - 1e-12:
                out[i, j] = round(s, 9)
    return out


@pytest.mark.parametrize(("threshold", "tile"), [(0.9, 512), (0.95, 512), (0.8, 512), (0.9, 13)])
def test_equals_all_pairs(spark, monkeypatch, threshold, tile):
    monkeypatch.setattr("skein.operators.structure.TILE", tile)
    r = random.Random(6)
    base = [[r.choice(["# h", "## h", "text", "- a", "> q", "```\nx\n```", "---"]) for _ in range(r.randint(0, 14))] for _ in range(12)]
    texts = []
    for _ in range(150):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            if t and r.random() < 0.5:
                t.pop(r.randrange(len(t)))
            else:
                t.insert(r.randint(0, len(t)), r.choice(["text", "- a", "### h"]))
        texts.append("\n\n".join(t))
    prints = [(i, fingerprint(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, f["sequence"], f["depth"], f["complexity"]) for i, f in prints], PRINTS).repartition(4)
    pairs, classes = similar_structures(df, threshold)
    rows = pairs.collect()
    assert {(x["a"], x["b"]): round(x["similarity"], 9) for x in rows} == all_pairs(prints, threshold) and len(rows) == len({(x["a"], x["b"]) for x in rows}) > 20
    n = classes.count()
    assert classes.agg(F.sum("members")).first()[0] == 150 and sum(x["tried"] for x in rows) < n * (n - 1) / 2 * (0.5 if threshold >= 0.9 else 0.9)
    with pytest.raises(ValueError):
        similar_structures(df, 0.7)
    assert similar_structures(df.where("id < 0"), threshold)[0].count() == 0


def test_query(spark):
    prints = [(r["conv_id"], {"sequence": [x for x in r["sequence"].split("-") if x], "depth": r["depth"], "complexity": r["complexity"]}) for r in catalog.queries()["str22_fingerprints"](spark, FOLDER).collect()]
    got = {(r["a"], r["b"]): r["similarity"] for r in catalog.queries()["str22_similar_structures"](spark, FOLDER).collect()}
    assert got == all_pairs(prints, 0.9) and got
