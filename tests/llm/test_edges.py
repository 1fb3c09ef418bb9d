"""Every stage of the pipeline on odd rows, and every opN_ query as it is registered."""

import math
import os
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from skein.llm import queries

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")
#: Columns named like helpers inside the operators, beside those of documents.
CLASH = "drops string, _s int, row string, i int, h int, s string, copies int, lang_pred string, score double, _ld_dropped int, text_hash int, rank int, _gone int, lines string, n int, id string, rep int, node int, `a.b` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars int, {CLASH}"
EXTRA = ("d", 1, "r", 2, 3, "s", 4, "xx", 0.5, 5, 6, 7, 8, "l", 9, "z", 10, 11, "dot")
STAGES = [pytest.param(f, id=name) for name, f in corpus_pipeline.STAGES]


def odd_rows():
    long_line, long_text = "word" * 5000, "many words stand here in a row " * 4000
    base = " ".join(f"token{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    rows = [
        (1, "The first line\nThe second line of it", "en", "a"), (2, "The first line\nDer zweite Satz steht hier", "de", "a"),
        (3, None, "en", "a"), (4, "", "en", "b"), (5, " \n\t\n", None, "b"), (6, "?! 12 ...", "en", None), (7, "one", None, None),
        (None, "Nobody has this text here", "en", "a"), (None, None, None, None), (8, base, "en", "c"), (9, base + " more", "en", "c"), (10, base, "en", "c"),
        (11, long_line, "en", "c"), (12, long_text, "en", "hot"), (13, "Älter ÜBER ß İ 𐌰𐌱", "de", "hot"), (14, "a", "en", ""), (15, "b", "en", "d"),
        (1, "The first line\nThe second line of it", "en", "a"), (7, "another text of the same id", "en", "a"),
    ]
    return [(i, t, la, s, len(t) if t is not None else None, *EXTRA) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("stage", STAGES)
def test_stage_of_odd_rows(spark, odd, stage):
    out = stage(spark, odd, "")
    got = out.collect()
    last = stage is corpus_pipeline.STAGES[-1][1]
    if not last:
        assert out.columns == odd.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        fixed = [c for c in odd.columns if c not in ("text", "lang", "n_chars")]
        there = {tuple(r[c] for c in fixed) for r in odd.collect()}
        assert {tuple(r[c] for c in fixed) for r in got} <= there
    ids = Counter(r["doc_id"] for r in got)
    name = dict((f, n) for n, f in corpus_pipeline.STAGES)[stage]
    if name == "language_id":
        assert set(ids) == {None, 1, 2, 7, *range(8, 16)} and ids[None] == 1 and ids[1] == 2 and ids[7] == 2
        assert all(r["lang"] in ("de", "en") for r in got)
    elif name == "line_dedup":
        text = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
        assert text[2] == "Der zweite Satz steht hier" and text[3] is None and text[4] == "" and text[5] == " \n\t\n" and ids[1] == 2 and 10 not in ids
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    elif name == "minhash_dedup":
        assert set(ids) == {None, *range(1, 9), *range(11, 16)} and ids[None] == 2 and ids[1] == 2 and ids[7] == 2
    elif name == "mixing":
        assert max(ids.values()) <= 4 and 3 not in {r["doc_id"] for r in got if r["source"] == "x"}
    else:
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in odd_rows())


@pytest.mark.parametrize("stage", STAGES)
def test_stage_of_an_empty_table(spark, odd, stage):
    assert stage(spark, odd.where("false"), "").count() == 0


@pytest.mark.parametrize("stage", STAGES)
def test_stage_of_nulls_alone(spark, stage):
    d = spark.createDataFrame([(None,) * len(odd_rows()[0])] * 3, SCHEMA)
    assert stage(spark, d, "").count() == {"language_id": 0, "mixing": 0}.get(dict((f, n) for n, f in corpus_pipeline.STAGES)[stage], 3)


@pytest.mark.parametrize("stage", STAGES[:4])
def test_stage_gives_the_same_again(spark, odd, stage):
    once, again = (Counter(map(repr, stage(spark, odd.repartition(n), "").collect())) for n in (1, 5))
    assert once == again


# ------------------------------------------------------------------ the registered queries

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def result(spark):
    known = {}

    def of(name):
        if name not in known:
            known[name] = queries.queries()[name](spark, FOLDER).collect()
        return known[name]

    return of


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@needs_tables
@pytest.mark.parametrize(("name", "mod", "rest"), [("op1_language_id", 5, 0), ("op8_toxicity", 3, 1)])
def test_scores_of_all_documents(spark, result, duck, name, mod, rest):
    got = result(name)
    ids = [i for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall()]
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    if name == "op1_language_id":
        truth = dict(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL").fetchall())
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
        assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    else:
        assert all(r["predicted"] == int(r["score"] >= 0.7) and r["by_language"] in (0, 1) for r in got)


@needs_tables
def test_pieces_of_all_documents(result, duck):
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    got = result("op3_packing")
    assert {tuple(r[:5]) for r in got} == want and len(got) == len(want)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(result, duck, name):
    got, want = result(name), duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    text = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[n]) for n in names) for r in got) == sorted(tuple(map(text, r)) for r in want.fetchall())
    if name == "op5_sharding":
        assert len({r["shard"] for r in got}) >= 1


@needs_tables
def test_near_documents_equal_brute_force(result, duck):
    from tests.llm.test_operators import brute_near

    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result("op7_minhash_dedup")} == brute_near(rows, 4)


@needs_tables
def test_kept_lines_equal_brute_force(result, duck):
    from tests.llm.test_operators import brute_lines

    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {i: (len(t), zlib.crc32(t.encode())) for i, t in brute_lines(rows).items()}
    assert {r["doc_id"]: (r["chars_kept"], r["text_crc32"]) for r in result("op2_line_dedup") if r["chars_kept"] is not None} == want


@needs_tables
def test_vectors_equal_brute_force(result, duck):
    import numpy as np

    rows = duck.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v, _ in rows], float)
    ids, label = np.array([i for i, _, _ in rows]), np.array([-1 if la is None else la for _, _, la in rows])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = (u @ u.T >= 0.93) & (label[:, None] == label) & (label >= 0)[:, None] & ~np.eye(len(ids), dtype=bool)
    assert {r["vec_id"]: r["n_links"] for r in result("op4_vector_dedup")} == dict(zip(ids.tolist(), hit.sum(1).tolist(), strict=True))
    whole = np.floor(64 * x).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = whole @ whole[q]
        best = sorted((-int(v), int(i)) for v, i in zip(s, ids, strict=True) if i != ids[q])[:20]
        want |= {(int(ids[q]), k + 1, i, -v) for k, (v, i) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result("op10_exact_topk")} == want


@needs_tables
def test_passages_run(result):
    assert all(r["end_word"] - r["start_word"] >= 50 and r["other_doc"] != r["doc_id"] for r in result("op9_suffix_dedup"))
