"""Seeking needles in texts against the plain locator on all pairs."""

import os
import random

import pytest

from skein.operators.matching import fuzzy_locate
from skein.operators.seek import Needles, seek
from skein.plans import catalog

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")


def loop(needles, texts):
    out = []
    for i, n in needles:
        for d, t in texts:
            if n is not None and t is not None:
                h = fuzzy_locate(n, t)
                if h.method != "approximate":
                    out.append((i, d, h.start, h.end, round(h.confidence, 9), h.method))
    return sorted(out)


def sought(spark, needles, texts):
    df = seek(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "document_id long, text string").repartition(3))
    return sorted((*r[:4], round(r[4], 9), r[5]) for r in df.collect())


@pytest.mark.parametrize("alphabet", ["abc ", "abcdefghij klmn\n", "aΣσς bİé\t"])
def test_equals_all_pairs(spark, alphabet):
    r = random.Random(len(alphabet))
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    texts = [(i, text(r.choice([0, 3, 50, 400, 900]))) for i in range(40)] + [(90, None), (91, "   ")]
    needles = []
    for i in range(60):
        t = r.choice([t for _, t in texts if t])
        a = r.randrange(len(t))
        n = list(t[a:a + r.choice([2, 5, 40, 120])])
        for _ in range(r.choice([0, 1, 3, 9])):
            if n:
                n[r.randrange(len(n))] = r.choice("abcxyz ")
        needles.append((i, "".join(n)))
    needles += [(100, None), (101, ""), (102, "ab"), (103, text(60))]
    assert sought(spark, needles, texts) == loop(needles, texts)


def test_few_windows_are_scored():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = " ".join(word() for _ in range(3000))
    needle = text[9000:9300].replace("a", "x", 4)
    block = Needles([(1, needle), (2, " ".join(word() for _ in range(40)))])
    got = list(block.hits(text))
    assert [j for j, _ in got] == [0] and got[0][1].method == "fuzzy" and abs(got[0][1].start - 9000) <= 60
    assert block.tried < 25  # of about 700


def test_blocks_of_needles(spark, monkeypatch):
    texts = [(1, "one two three four five six"), (2, "seven eight nine ten")]
    needles = [(i, f"two three four {i}") for i in range(5)]
    whole = sought(spark, needles, texts)
    monkeypatch.setattr("skein.operators.seek.BLOCK_BYTES", 30)
    assert sought(spark, needles, texts) == whole == loop(needles, texts) and whole


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    needles = [(r["item_id"], r["text"] + " changed") for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = sorted((*r[:4], round(r[4], 9), r[5]) for r in catalog.queries()["str3_fuzzy_locate"](spark, FOLDER).collect())
    assert got == loop(needles, docs) and any(r[5] == "fuzzy" for r in got)
