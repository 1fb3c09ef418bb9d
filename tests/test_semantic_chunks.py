"""Topics that change at known places, exact offsets, and models that see sentences only."""

import random

import numpy as np

from skein.operators.semantic_chunks import hashed_words, semantic_chunks
from skein.plans import catalog

TOPICS = ["river mill water bridge bank boat flood stream", "proof lemma number prime sum factor root square", "bread oven flour salt yeast dough crust loaf"]


def written(seed):
    """A text of several topics, and where they change."""
    r = random.Random(seed)
    out, cuts, last = "", [], None
    for _ in range(r.randint(2, 5)):
        topic = r.choice([t for t in TOPICS if t != last])
        last = topic
        if out:
            cuts.append(len(out))
        for _ in range(r.randint(6, 10)):
            out += " ".join(r.choice(topic.split()) for _ in range(r.randint(6, 10))).capitalize() + r.choice([". ", "! ", ".\n\n"])
    return out, cuts


def test_planted_changes_are_found(spark):
    texts = {i: written(i) for i in range(30)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "document_id long, text string").repartition(4)
    got: dict = {}
    for r in semantic_chunks(docs).collect():
        got.setdefault(r["document_id"], []).append(r)
    found = planted = extra = 0
    for i, (text, cuts) in texts.items():
        own = sorted(got[i], key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in own] == list(range(len(own))) and own[0]["start_offset"] == 0 and own[-1]["end_offset"] == len(text)
        assert all(a["end_offset"] == b["start_offset"] for a, b in zip(own, own[1:])) and all(text[r["start_offset"]:r["end_offset"]] == r["content"] for r in own)
        ends = {r["start_offset"] for r in own[1:]}
        found, planted, extra = found + len(ends & set(cuts)), planted + len(cuts), extra + len(ends - set(cuts))
    assert found >= 0.9 * planted and extra <= 0.15 * planted


def test_models_are_injected_and_see_sentences_only(spark):
    def last_letter(batch):
        assert all(len(s) < 40 for s in batch) and len(batch) <= 256
        return np.array([[s.strip()[-2] == "a", s.strip()[-2] == "b"] for s in batch], float)

    text = "One aa. Two aa. Three aa. Four bb. Five bb. Six bb. "
    docs = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "Only one a.")], "document_id long, text string")
    got = sorted((r["document_id"], r["start_offset"], r["content"]) for r in semantic_chunks(docs, last_letter).collect())
    assert got == [(1, 0, "One aa. Two aa. Three aa. "), (1, 26, "Four bb. Five bb. Six bb. "), (4, 0, "Only one a.")]
    long = semantic_chunks(docs, last_letter, most=4).where("document_id = 1").orderBy("chunk_index").collect()
    assert [r["content"] for r in long] == ["One aa. Two aa. ", "Three aa. ", "Four bb. Five bb. ", "Six bb. "]
    assert hashed_words(["a a b"]).sum() == 3 and hashed_words([""]).sum() == 0


def test_query(spark):
    rows = catalog.queries()["tg2_semantic_chunks"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    whole = {}
    for r in sorted(rows, key=lambda r: (r["document_id"], r["chunk_index"])):
        assert docs[r["document_id"]][r["start_offset"]:r["end_offset"]] == r["content"]
        whole[r["document_id"]] = whole.get(r["document_id"], "") + r["content"]
    assert whole == {i: t for i, t in docs.items() if t and t.strip()} and len(rows) > len(whole)


def test_gaps_do_not_depend_on_lots(spark):
    from skein.operators.semantic_chunks import sentences

    docs = spark.createDataFrame([(i, written(i)[0]) for i in range(6)] + [(9, "One."), (10, "")], "document_id long, text string").repartition(2)
    rows = [sorted((r["document_id"], r["seq"], r["gap"] is None, round(r["gap"] or 0, 9)) for r in sentences(docs, hashed_words, lot).collect()) for lot in (1, 2, 5, 256)]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) > 60
