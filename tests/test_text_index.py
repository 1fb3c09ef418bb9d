"""Stems against published pairs, searches against a loop over all rows."""

import itertools
import os
import re

import pytest

from skein.functions.stemming import STOP, stem
from skein.operators.text_index import Clause, Item, TextIndex, clauses, cover_density
from skein.plans import catalog, q_text

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")

STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori
 consoling consol consolingly consol consonant conson knack knack knackeries knackeri knightly knight knocked knock knots knot knotty knotti knowledge knowledg caresses caress ponies poni ties tie
 cats cat agreed agre feed feed plastered plaster bled bled motoring motor sing sing hopping hop hoping hope falling fall hissing hiss failing fail filing file happy happi sky sky say say by by
 relational relat conditional condit rational ration valency valenc digitizer digit radically radic differently differ analogously analog vietnamization vietnam predication predic operator oper
 feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit triplicate triplic formative format formalize formal electrical electr hopeful hope
 goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
 communism communism generate generat generous generous arsenal arsenal gas gas this this kiwis kiwi gaps gap dying die news news succeed succeed inning inning proceeds proceed skies sky luxuriated luxuri
 troubled troubl sized size tanned tan bias bias probate probat rate rate cease ceas controll control roll roll"""


def test_stems():
    words = STEMS.split()
    wrong = [(w, stem(w), s) for w, s in zip(words[::2], words[1::2], strict=True) if stem(w) != s]
    assert not wrong


def terms(text):
    out = {}
    for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower())):
        if w not in STOP:
            out.setdefault(stem(w), []).append(i)
    return out


def holds(item: Item, own: dict) -> list[int]:
    if item.prefix:
        return sorted(p for t, ps in own.items() if t.startswith(item.terms[0][1]) for p in ps)
    return [p for p in own.get(item.terms[0][1], []) if all(p + k in own.get(t, []) for k, t in item.terms)]


def nearness(lists):
    """All stretches that hold one of each, without those that hold another."""
    every = {(min(x), max(x)) for x in itertools.product(*lists)}
    least = {(a, b) for a, b in every if not any((c, d) != (a, b) and a <= c and d <= b for c, d in every)}
    return sum(1 / (1 + max(0, b - a + 1 - len(lists))) for a, b in least)


def loop(rows, query):
    asked, out = clauses(query), {}
    for key, text in rows:
        own = terms(text)
        places = [sorted({p for i in c.items for p in holds(i, own)}) for c in asked]
        if asked and all(bool(p) != c.negative for p, c in zip(places, asked, strict=True)):
            wanted = [p for p, c in zip(places, asked, strict=True) if not c.negative]
            out[key] = round(nearness(wanted), 9) if wanted else 0.0
    return out


def test_clauses():
    assert clauses("cats -dogs") == [Clause((Item(((0, "cat"),)),)), Clause((Item(((0, "dog"),)),), True)]
    assert clauses('"the cats of war" or run*') == [Clause((Item(((0, "cat"), (2, "war"))), Item(((0, "run"),), True)))]
    assert clauses("the of") == [] and clauses("") == []


def test_nearness():
    for lists in ([[1, 9], [3], [8, 20]], [[1]], [[1, 2, 3], [2, 3]], [[5], [5]]):
        assert cover_density(lists) == pytest.approx(nearness(lists))
    assert cover_density([[1], []]) == 0 and cover_density([]) == 0


def test_small_table(spark, tmp_path):
    rows = [(1, "The cats are running home"), (2, "a cat ran home"), (3, "running, CATS! and dogs"), (4, None), (5, ""), (6, "home of the cat; the cat's home"), (7, "Élan vital 42nd élan"), (8, "catalogue of homes")]
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    index = TextIndex.build(df, ["id"], "body", f"{tmp_path}/ix")
    for query in ("cats running", "cat home", '"cat home"', '"home of the cat"', "cat*", "cat* -dogs", "-cat", "ran or dogs", '"cat ran" or élan', "42nd", "the", "", "-the", "nothing", "cat or run* home"):
        assert {r["id"]: r["score"] for r in index.search(query).collect()} == loop(rows, query), query


def test_only_own_postings_are_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} alpha beta") for i in range(100)], "id long, body string")
    index = TextIndex.build(df, ["id"], "body", f"{tmp_path}/ix")
    plan = index.read(clauses("alpha beta*")[0].items + clauses("alpha beta*")[1].items)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*head", plan) and re.search(r"PushedFilters: \[[^\]]*(In|EqualTo|Or)\(?.*term", plan)
    assert index.search("word7").count() == 1


def test_shapes_equal_a_loop(spark):
    rows = [((r["conv_id"], r["turn"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    got = {}
    for r in catalog.queries()["flt11_query_shapes"](spark, FOLDER).collect():
        got.setdefault(r["shape"], {})[r["conv_id"], r["turn"]] = r["score"]
    assert sum(len(g) > 0 for g in got.values()) >= 7
    for i, q in enumerate(q_text.SHAPES):
        assert got.get(i, {}) == loop(rows, q), q


def test_each_distinct_word_is_stemmed_once(spark, tmp_path, monkeypatch):
    """However often it stands in the texts; stop words are not stemmed at all."""
    said = str(tmp_path / "said")

    def told(word):
        with open(said, "a") as f:
            f.write(f"{word}\n")
        return stem(word)

    monkeypatch.setattr("skein.operators.text_index.stem", told)
    df = spark.createDataFrame([(i, "The cats are running, the cats ran") for i in range(200)], "id long, body string").repartition(4)
    index = TextIndex.build(df, ["id"], "body", f"{tmp_path}/ix")
    assert sorted(open(said).read().split()) == ["cats", "ran", "running"]
    assert index.search("cats ran").count() == 200 and index.search("the").count() == 0
