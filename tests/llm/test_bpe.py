"""op11 against the tokenizers library, token by token."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def own(path):
    return bpe.SpeculativeTokenizer(path)


def odd_texts():
    r = random.Random(1)
    signs = ["a", "b", "th", "ing", "é", "'s", "'", "!", "..", "1", " ", " ", "　", "İ", "ß", "ﬁ", "é", "你好", "😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\n", "\x1c", "ͅ", "Σ", "aaaa", "xx", "ʼn", "​", "﻿", "\t", "_", "-", "K"]
    out = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    out += ["".join(r.choice("etaoinsh") for _ in range(r.randint(1, 30))) for _ in range(5000)]
    return [*out, "x" * 30000, "ab" * 5000, "".join(r.choice("abcdefgh") for _ in range(20000)), "", " ", " ", "the The THE"]


def test_texts_equal_the_library(own, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.texts(pa.array(texts))] == want
    speller = bpe.Speller(own.merges.vocabulary, own.added)
    assert [speller.spell(np.array(x)).decode() for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_words_are_proposed_tested_and_merged(own):
    m = own.merges
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    flat = np.array([m.vocabulary[c] if k < len(w) - 1 else m.vocabulary[c + "</w>"] for w in words for k, c in enumerate(w)])
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, at, failed = m.encode(flat, begin)
    exact = m.exact(flat, begin)
    assert all((ids[at[k]:at[k + 1]] == x).all() and at[k + 1] - at[k] == len(x) for k, x in enumerate(exact))
    proposed, p = m.greedy(flat, begin)
    wrong = [k for k, x in enumerate(exact) if proposed[p[k]:p[k + 1]].tolist() != x.tolist()]
    assert 0 < len(wrong) <= failed < len(words)  # every wrong proposal fails a test, most words need no merging
    for k in range(0, 300):
        assert m._heap(flat[begin[k]:begin[k + 1]].tolist()).tolist() == exact[k].tolist()


def test_pairs_apart_equals_merging(own):
    m = own.merges
    r = np.random.default_rng(2)
    inner = np.array([i for t, i in m.vocabulary.items() if not t.endswith("</w>")])
    a, b = r.choice(inner, 4000), r.integers(0, m.size - 2, 4000)
    symbols = {}

    def own_symbols(t):
        if t not in symbols:
            symbols[t] = [t] if m.rank[t] < 0 else own_symbols(int(m.left[t])) + own_symbols(int(m.right[t]))
        return symbols[t]

    got = m.apart(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        s = own_symbols(x) + own_symbols(y)
        assert ok == (m.exact(np.array(s), np.array([0, len(s)]))[0].tolist() == [x, y])


def test_vocabularies_that_are_refused():
    base = {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3, "ba": 4}}
    with pytest.raises(ValueError):
        bpe.Merges(base | {"merges": [["ab", "a"], ["a", "b"]]})  # a part made later
    with pytest.raises(ValueError):
        bpe.Merges(base | {"merges": [["a", "b"], ["b", "a"], ["ab", "a"], ["a", "ba"]]})  # two merges for one token
    m = bpe.Merges(base | {"merges": [["a", "b"], ["b", "a"], ["a", "ba"]]})
    assert not m.sound[3] and m.sound[4]  # merging a, b, a gives ab, a
    assert m.encode(np.array([0, 1, 0]), np.array([0, 3]))[0].tolist() == [2, 0]


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_bpe_round_trip(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert tuple(got[d["doc_id"]])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_odd_rows(spark, path, library):
    rows = [(1, None, "k"), (2, "", "k"), (None, "two words", "k"), (3, "same", "k"), (3, "same", "k"), (4, "long " * 50000, "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(d, path)
    got = sorted((r["doc_id"] or 0, list(r["ids"]), r["decoded"]) for r in out.collect())
    assert got == sorted((i or 0, e.ids, library.decode(e.ids, skip_special_tokens=False)) for i, t, _ in rows for e in [library.encode(t or "", add_special_tokens=False)])
    back = {tuple(r) for r in bpe.decode(out, path).collect()}
    assert back == {(r["doc_id"], r["decoded"]) for r in out.collect()}
    assert [r["decoded"] for r in bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).collect()] == [None]
    assert bpe.encode(d.where(F.lit(False)), path).count() == 0
