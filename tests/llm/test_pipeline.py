"""The pipeline, stage by stage against the operators' brute force."""

import re
from collections import Counter

import pytest

from tests.llm.test_operators import brute_lines, brute_near, corpus, docs_of, tokenizer  # noqa: F401


def test_stages(spark, corpus, tokenizer, tmp_path):  # noqa: F811
    import corpus_pipeline

    rows = [(i, t, la, s) for i, t, la, s in corpus if i not in (115, 116)]
    rows = list({r[0]: r for r in rows}.values())
    docs_of(spark, rows).write.parquet(f"{tmp_path}/in/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    names = d.columns
    held = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, d, f"{tmp_path}/in").write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "packing" or d.columns == names
        held.append(d.collect())
    start = {r[0]: r[1] for r in rows}
    assert {r["doc_id"] for r in held[0]} == {i for i, t in start.items() if re.search(r"[^\W\d_]", t or "")}
    lines = brute_lines([(r["doc_id"], r["text"]) for r in held[0]])
    assert {r["doc_id"]: r["text"] for r in held[1]} == {i: t for i, t in lines.items() if t.strip()}
    near = brute_near([(r["doc_id"], r["text"]) for r in held[1]], 5)
    assert {r["doc_id"] for r in held[2]} == {i for i, v in near.items() if v[2]}
    assert {r["doc_id"] for r in held[3]} <= {r["doc_id"] for r in held[2]}
    assert Counter(r["doc_id"] for r in held[4] if r["piece"] == 0) == Counter(r["doc_id"] for r in held[3])
    whole = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in held[4])


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "minhash_dedup", "mixing", "packing"])
def test_stage_names(name):
    import corpus_pipeline

    assert name in dict(corpus_pipeline.STAGES)


def test_no_name_of_a_language_costs_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"some words of a text {i}", "und" if i % 2 else "en", "s") for i in range(20)] + [(20, "1 2 3", "en", "s"), (21, None, "und", "s")]
    out = corpus_pipeline.identify_language(spark, docs_of(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))
