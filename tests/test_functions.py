"""Pure functions and operators on hand-written rows."""

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import chunking, intervals, matching, scheduling
from skein.operators import text as T
from skein.operators.engines import Registry, combine
from skein.plans.q_study import normalised
from skein.sources import readers


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


# ------------------------------------------------------------------ column expressions

def test_polarity_lexicon(spark):
    r = X.regex_metadata(spark.createDataFrame([("This is Good and great. A bad day. Paris",)], "t string"), "t").first()
    assert r["polarity"] == pytest.approx(0.1) and r["primary_emotion"] == "positive" and r["summary"] == "This is Good and great." and r["themes"] == ["this", "good", "paris"]


@pytest.mark.parametrize("message,kind", [("Network error", "transient"), ("HTTP 503", "transient"), ("quota exceeded", "paywall"), ("Invalid JSON", "invalid"), ("boom", "permanent")])
def test_errors(spark, message, kind):
    assert one(spark, X.error_class(F.col("m")), m=message) == kind


def test_paste(spark):
    assert one(spark, X.paste_format(F.col("t")), t="# a\n\n- b **c**").format == "markdown"
    assert one(spark, X.paste_format(F.col("t")), t="function foo() {}\n    x").format == "code"
    assert one(spark, X.paste_format(F.col("t")), t=" ".join(f"[0{i}:10] word" for i in range(7))).format == "transcript"
    assert one(spark, X.paste_format(F.col("t")), t="plain").format == "plain_text"


def test_cloze(spark):
    t = "{{c2::b}} {{c1::a::hint}} {{c1::z}}"
    assert [(d["index"], d["text"], d["hint"]) for d in one(spark, X.cloze_deletions(F.col("t")), t=t)] == [(1, "a", "hint"), (2, "b", None)]
    assert one(spark, X.cloze_question(F.col("t"), F.lit(2)), t=t) == "[...] a z"
    assert one(spark, X.cloze_question(F.col("t"), F.lit(1)), t=t) == "b [...hint] [...]"
    assert one(spark, X.cloze_is_sequential(F.col("t")), t="{{c1::a}} {{c3::b}}") is False


def test_html(spark):
    h = "<p onclick=\"x()\">a</p><script>bad</script><a href='javascript:x'>l</a><img src=\"data:1\">"
    assert one(spark, X.sanitize_html(F.col("h")), h=h) == '<p>a</p><a href="#">l</a><img src="">'
    assert T.html_to_markdown("<h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li></ul>") == "# T\n\na **b** [c](u)\n\n- x"


def test_small_ones(spark):
    assert one(spark, X.slug(F.col("t")), t="Héllo,  World!") == "h-llo-world"
    assert one(spark, X.tags(F.col("t")), t="#Ab x #ab") == ["ab", "ab"]
    assert one(spark, X.stamp_seconds(F.col("t")), t="[1:02:03] [04:05]") == [3723, 245]
    assert one(spark, X.video_id(F.col("t")), t="https://youtu.be/abcdefghijk") == "abcdefghijk"
    assert one(spark, X.document_type(F.lit("Physics"), F.lit(None), F.lit("x"), F.lit(None))) == "academic_paper"
    assert one(spark, X.render_template(F.lit("{{a}}-{{b}}"), F.create_map(F.lit("a"), F.lit("1")))) == "1-{{b}}"
    assert one(spark, X.tidy(F.lit("“a”  –\n\n\n\n b "))) == '"a" -\n\nb'
    assert one(spark, X.front_matter(F.lit("---\ntitle: T\n---\nx"), "title")) == "T"
    assert one(spark, normalised(F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), F.lit(0.0)))) == {"a": 0.5, "b": 0.5}


# ------------------------------------------------------------------ matching

def test_fuzzy_locate():
    src = words(1, 200)
    assert matching.fuzzy_locate(src[100:300], src) == matching.Hit(100, 300, 1.0, "exact")
    h = matching.fuzzy_locate(src[100:300].replace(" ", "\n  "), src)
    assert h.method == "exact" and src[h.start:h.end].split() == src[100:300].split()
    h = matching.fuzzy_locate(src[100:280] + " changed", src)
    assert h.method == "fuzzy" and abs(h.start - 100) <= 20
    assert matching.fuzzy_locate("nothing like it here at all", src, 1, 4).method == "approximate"


def test_match_annotation():
    src = words(2, 150)
    assert matching.match_annotation(src[50:120], src).method == "exact"
    n = src[50:120]
    edited = src[:50] + n[:10] + "X" + n[11:] + src[120:]
    assert matching.match_annotation(n, edited, src[20:50], src[120:150]).method == "context"
    assert matching.match_annotation(n, edited, near=edited[40:140], near_at=40).method == "chunk_bounded"
    assert matching.match_annotation("zzzz qqqq yyyy", src) is None


def test_match_offsets_and_stitch():
    src = words(3, 400)
    cut = [src[i:i + 300] for i in range(0, len(src), 300)]
    hits = matching.match_offsets(cut, src)
    assert [(h.start, h.end) for h in hits] == [(i * 300, min(len(src), i * 300 + 300)) for i in range(len(cut))]
    assert matching.match_offsets([cut[0], "nope", cut[2]], src)[1].method == "interpolated"
    parts = [src[s:s + 500] for s in range(0, len(src) - 100, 400)]
    assert matching.stitch(parts, share=1.0) == src
    assert matching.stitch(["abc", "def"]) == "abc\n\ndef"


def test_long_chunks_are_matched_by_edits():
    src = words(5, 600)
    for n in (500, 1500):
        cut = "".join("#" if i % 25 == 7 else c for i, c in enumerate(src[:n]))
        for h in (matching.match_offsets([cut], src)[0], matching.correct_offsets([cut], src)[0]):
            assert (h.start, h.end, h.method) == (0, n, "edits") and h.confidence >= 0.95


def test_edit_distance_equals_the_recurrence():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randrange(90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert matching.edit_distance(a, b) == row[-1]


def test_locate_all_equals_the_function(spark):
    rows = [(i, words(i, 80)) for i in range(6)]
    needles = [(i, i, t[30:150] if i % 2 else t[30:150] + "zz") for i, t in rows]
    got = {r["needle_id"]: r for r in matching.locate_all(spark.createDataFrame(needles, "needle_id long, document_id long, needle string"), spark.createDataFrame(rows, "document_id long, text string")).collect()}
    for i, _, n in needles:
        h = matching.fuzzy_locate(n, rows[i][1])
        assert (got[i]["start"], got[i]["end"], got[i]["method"]) == (h.start, h.end, h.method)


# ------------------------------------------------------------------ chunking

def test_heading_chunks():
    md = "# A\n\n" + "x " * 150 + "\n\n## B\n\n" + "y " * 150 + "\n\n# C\n\nshort"
    c = chunking.heading_chunks(md)
    assert [x["heading_path"] for x in c] == ["A", "A/B"] and all(md[x["start"]:x["end"]].startswith("#") for x in c)


@pytest.mark.parametrize("name", ["token", "sentence", "recursive"])
def test_chunks_cover_all_words(name):
    t = ". ".join(words(i, 30) for i in range(20)) + "\n\n" + words(99, 700)
    c = chunking.CHUNKERS[name](t, size=100)
    assert [w for x in c for w in t[x["start"]:x["end"]].split()] == t.split()
    assert name == "sentence" or all(x["tokens"] <= 100 for x in c)  # sentences stay whole


def test_pieces_and_blocks():
    t = words(5, 3000)
    p = chunking.bounded_pieces(t, 1000)
    assert "".join(t[a:b] for a, b in p) == t and max(b - a for a, b in p) <= 1000
    b = chunking.blocks("# h\ntext\nmore\n\n- a\n- b\n```\ncode\n\nx\n```\n> q")
    assert [x["kind"] for x in b] == ["heading", "paragraph", "list", "code", "quote"]
    f = chunking.fingerprint("# h\n\ntext\n\n- a")
    assert chunking.fingerprint_similarity(f, f) == pytest.approx(1.0)


# ------------------------------------------------------------------ the rest

def test_schedule_grows_with_good_answers():
    a, b = scheduling.fold([(0, 3), (4, 3)]), scheduling.fold([(0, 3), (4, 1)])
    assert a["stability"] > b["stability"] and b["lapses"] == 1 and a["due_day"] > 4


def test_harmonic_mean_of_zero_is_zero(spark):
    e = spark.createDataFrame([(1, "a", 0.0), (1, "a", 1.0)], "target long, connection_type string, strength double")
    assert combine(e, {"a": 1.0}, "harmonic_mean").first()["score"] == 0.0


def test_registry(spark):
    r = Registry()
    r.register("x", lambda c: spark.createDataFrame([(1, 2, "x", 0.5), (1, 2, "x", 0.7)], "source long, target long, connection_type string, strength double"))
    assert r.names() == ["x"] and r.run(None).first()["strength"] == 0.7
    r.clear()
    assert r.get("x") is None


def test_intervals_meet_once_across_buckets(spark):
    a = spark.createDataFrame([(1, 0, 10_000)], "document_id long, start_offset int, end_offset int")
    b = spark.createDataFrame([(1, 3_000, 9_000), (1, 10_000, 10_010), (2, 0, 5)], "document_id long, r_start int, r_end int")
    assert intervals.overlapping(a, b).count() == 1 and intervals.overlapping(a, b, inclusive_end=True).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nbody")
    (tmp_path / "b.html").write_text("<h1>Web</h1><p>x</p>")
    assert readers.read(spark, "markdown_asis", str(tmp_path)).first()["title"] == "Title"
    assert readers.read(spark, "web_url", str(tmp_path)).first()["markdown"] == "# Web\n\nx"
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>')
        z.writestr("o/b.opf", '<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="i" href="x.html"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/x.html", "<h1>One</h1><p>text</p>")
    got = readers.read(spark, "epub", str(tmp_path)).first()
    assert (got["title"], got["markdown"]) == ("Book", "# One\n\ntext")
    with pytest.raises(ValueError):
        readers.read(spark, "nope", "x")
    assert readers.extract_json("```json\n{\"a\": [1,],}\n```") == {"a": [1]}


def test_queries_over_texts_read_whole_tables(spark, tmp_path):
    from skein.plans import catalog

    texts = {0: "", 1: words(1, 3), 2: words(2, 9), 3: words(3, 120), 4: words(4, 4500), 6: words(6, 15)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, texts[4][9000:9150]), (2, texts[3][30:200]), (3, "%%% nothing of the kind $$$")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("str3_fuzzy_locate", "str4_annotation_match", "str5_offset_matcher", "str6_offset_correction", "str7_stitching", "str30_offset_repair")}
    cut = {(d, i) for d, t in texts.items() for i in range(-(-len(t) // 500))}
    for n in ("str5_offset_matcher", "str6_offset_correction"):
        assert {(r["document_id"], r["chunk_index"]) for r in rows[n]} == cut
    assert {r["document_id"] for r in rows["str7_stitching"]} == set(texts)
    for n in ("str4_annotation_match", "str30_offset_repair"):
        assert {r["doc_id"] for r in rows[n]} == set(texts)
    got = {(r["needle_id"], r["document_id"]): r for r in rows["str3_fuzzy_locate"]}
    for i, d in ((i, d) for i, _ in items for d in texts):  # rows for hits, and only for these
        h = matching.fuzzy_locate(dict(items)[i] + " changed", texts[d])
        r = got.get((i, d))
        assert (r and (r["start"], r["end"], r["method"])) == (None if h.method == "approximate" else (h.start, h.end, h.method))
    assert got[1, 4]["method"] == got[2, 3]["method"] == "fuzzy" and (3, 4) not in got
    assert matching.match_annotation("", "some text", near="some") is None


def test_needles_are_found_in_all_texts_that_hold_them(spark):
    from skein.operators.matching import holding

    texts = [(1, "one two three four five six seven eight"), (2, "xone two three four five six"), (3, "two  three four five six seven"), (4, None), (5, ""), (1, "again: three four five six seven")]
    needles = [(10, "two three four five six"), (11, "three four"), (12, "e two three four five si"), (13, ""), (14, None), (10, "ree four five six seve")]
    got = holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(needles, "item long, needle string")).collect()
    want = sorted((i, t, k, n) for i, t in texts for k, n in needles if t and n and n in t)
    assert sorted((r["doc_id"], r["text"], r["item"], r["needle"]) for r in got) == want


@pytest.mark.parametrize("tile", [1024, 9])
def test_contradictions_equal_brute_force(spark, monkeypatch, tile):
    from skein.operators.engines import contradiction

    monkeypatch.setattr("skein.operators.engines.TILE", tile)

    r = random.Random(4)
    rows = [(i, i % 5, r.random() > 0.1, round(r.uniform(-1, 1), 2), round(r.random(), 2), ["all"] + [r.choice("abcdefgh") for _ in range(r.randint(0, 4))]) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, document_id long, is_current boolean, polarity double, importance double, concepts array<string>")
    want = set()
    for a in rows:
        found = []
        for b in rows:
            x, y = set(a[5]), set(b[5])
            if a[2] and b[2] and a[1] != b[1] and a[3] * b[3] < 0 and abs(a[3] - b[3]) >= 0.3 and len(x & y) >= 0.5 * len(x | y):
                s = min(1.0, 0.4 * len(x & y) / len(x | y) + 0.4 * abs(a[3] - b[3]) / 2 + 0.2 * (a[4] + b[4]) / 2)
                found.append((-round(s, 9), b[0]))
        want |= {(a[0], b) for _, b in sorted(found)[:20]}
    assert {(e["source"], e["target"]) for e in contradiction(d).collect()} == want and len(want) > 200


def test_trigram_counts(spark):
    """Counted in batches as by the column expressions; null and short texts too."""
    from skein.functions.sets import set_similarity, trigrams
    from skein.operators.similarity import trigram_counts

    texts = [("Ab\nab AB", "ab"), ("ÄÖÜ äöü", "äöü"), ("x😀y😀x😀", "😀y😀"), ("", ""), ("ab", "abc"), (None, "abc"), ("abc", None), ("ΑΣ ΟΔΟΣ", "ΟΔΟΣ")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id long, a string, b string")
    out = trigram_counts(df, "a", "b", ["id"])
    assert "MapInPandas" in out._jdf.queryExecution().analyzed().toString()
    shared = F.coalesce(F.try_divide("both", F.col("n_a") + F.col("n_b") - F.col("both")), F.when(F.col("both").isNotNull(), 1.0))
    got = {r["id"]: r["s"] for r in out.select("id", shared.alias("s")).collect()}
    want = {r["id"]: r["s"] for r in df.select("id", set_similarity(trigrams(F.col("a")), trigrams(F.col("b"))).alias("s")).collect()}
    assert got == want


def test_edit_distances_of_many_pairs(spark):
    """Many pairs at a time in bit vectors, at the edges of 64 bits, empty, equal and beyond ASCII: as one by one, and as Spark's own."""
    from skein.operators.similarity import line_distances

    rng = random.Random(4)
    made = lambda signs: "".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 128, 130))))
    pairs = [(i, made("abc "), made("abc ")) for i in range(900)] + [(900 + i, made("aäé"), made("aäé")) for i in range(20)] + [(999, "same", "same")]
    df = spark.createDataFrame(pairs, "id long, a string, b string").coalesce(1)
    got = {r["id"]: (r["distance"], r["n"]) for r in line_distances(df, "a", "b", ["id"]).collect()}
    assert got == {r["id"]: (r["d"], r["n"]) for r in df.select("id", F.levenshtein("a", "b").alias("d"), F.greatest(F.length("a"), F.length("b")).alias("n")).collect()}


def test_windows_that_cannot_match_are_passed_over(monkeypatch):
    """The trigram tier takes only windows apart that may share enough, and finds what a look at all windows finds."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(600))
    for seed in range(30):
        at = rng.randrange(len(text) - 60)
        needle = list(text[at:at + 60])
        for _ in range(seed % 8):
            needle[rng.randrange(60)] = "X"
        needle = "".join(needle) + "!"
        taken = []
        real = matching.trigram_set
        monkeypatch.setattr(matching, "trigram_set", lambda t, taken=taken: taken.append(t) or real(t))
        got = matching.match_annotation(needle, text)
        monkeypatch.setattr(matching, "trigram_set", real)
        every = [(matching.set_similarity(real(needle), real(text[k:k + 61])), -k) for k in matching.windows(needle, text)]
        v, k = max(every)
        want = matching.Hit(-k, -k + 61, v * 0.9, "trigram") if v >= 0.65 and v * 0.9 >= 0.6 else None
        assert got == want
        assert len(taken) < len(every) / 4
