"""Each operator against brute force on small tables, and on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import exact_topk, language_id, line_dedup, minhash_dedup, mixing, packing, sharding, suffix_dedup, toxicity, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source); columns `id` and `rank` clash with names used inside."""
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, "x", 7) for i, t, la, s in rows], DOCS).repartition(parts)


def prose(r, n, lang="en"):
    syllables = {"en": ["the", "and", "ing", "tion", "wh", "er"], "de": ["und", "ü", "sch", "ein", "keit", "ß"], "fr": ["é", "eau", "que", "è", "ment", "ou"]}[lang]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows = []
    shared = prose(r, 70)
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        t = "\n".join(prose(r, r.randint(3, 30), lang) for _ in range(r.randint(1, 6)))
        if i % 7 == 0:
            t += "\n" + shared
        rows.append((i, t, lang, f"s{i % 4}" if i % 9 else None))
    for k in range(60, 80):  # near copies of document 1, edited
        w = rows[1][1].split(" ")
        w[k % len(w)] = "edited"
        rows.append((k, " ".join(w), "de", "s1"))
    rows += [(i, rows[2][1], "fr", "hot") for i in range(80, 110)]  # exact copies
    rows += [(110, None, "en", "s0"), (111, "", "en", "s0"), (112, " \n\t ", None, "s1"), (113, "one two", "en", "s0"), (114, "one  two", "en", "s0"), (115, "x" * 30000, "en", "s2"), (116, "long " * 20000, "en", "s2"), (2, rows[2][1], "fr", "s2")]
    return rows


# ------------------------------------------------------------------ 1

def test_language(spark, corpus):
    d = docs_of(spark, corpus)
    model = language_id.train(d.where("doc_id % 5 <> 0"))
    got = {r[0]: r for r in language_id.predict(spark, d, model, "text", F.col("doc_id"), F.col("rank")).collect()}
    assert model[0] == ["de", "en", "fr"]
    assert all(0 <= r["score"] <= 1 and r["rank"] == 7 for r in got.values())
    assert [got[i]["lang_pred"] for i in (110, 111, 112)] == ["und"] * 3
    held = [(i, la) for i, t, la, _ in corpus if i % 5 == 0 and i < 110]
    assert sum(got[i]["lang_pred"] == la for i, la in held) >= 0.95 * len(held)
    empty = docs_of(spark, corpus[:1]).where("false")
    assert language_id.predict(spark, empty, model, "text", F.col("doc_id")).count() == 0
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(spark, d, none, "text", F.col("doc_id")).collect()} == {"und"}


def test_language_vectors_match_plain_loops():
    texts = ["The cat's  Tür, 9 a", "", "ÉCOLE İ école", "𐌰𐌱 Привет 你好", "?! 12"]
    vector = lambda c: language_id.letter_vectors(np.array([c], np.uint64))[0].astype(int)
    for text, got in zip(texts, language_id.bundle(texts), strict=True):
        s = [0]
        for ch in text:
            c = ord(ch.lower()[0]) if ch.isalpha() else 0
            if c or s[-1]:
                s.append(c)
        s += [0] * bool(s[-1])
        want = np.zeros(language_id.DIM, int)
        for k in (k for k in range(1, len(s) - 1) if s[k]):  # around each letter
            want += np.roll(vector(s[k - 1]), 2) * np.roll(vector(s[k]), 1) * vector(s[k + 1])
        assert (want == got).all(), text
    assert set(np.unique(language_id.letter_vectors(np.arange(500)))) == {-1, 1}
    near = language_id.letter_vectors(np.arange(1, 200)).astype(int)
    assert np.abs(near @ near.T - language_id.DIM * np.eye(199)).max() < 200  # near orthogonal


def test_language_ignores_company(spark):
    odd = ["ÉCOLE ÉTÉ", "İİİ", "the end", "𐌰𐌱𐌲", None]
    rows = [(i, t, "en", "s") for i, t in enumerate(odd)]
    model = language_id.train(docs_of(spark, [(i, t, la, "s") for i, (t, la) in enumerate([("école été", "fr"), ("the ending", "en"), ("𐌰𐌱𐌲𐌳", "got")])]))
    together = {r[0]: tuple(r) for r in language_id.predict(spark, docs_of(spark, rows, 1), model, "text", F.col("doc_id")).collect()}
    alone = {}
    for row in rows:
        alone |= {r[0]: tuple(r) for r in language_id.predict(spark, docs_of(spark, [row], 1), model, "text", F.col("doc_id")).collect()}
    assert together == alone and together[3][1] == "got" and together[0][1] == "fr" and together[4][1] == "und"


def test_language_ties_and_names(spark):
    d = docs_of(spark, [(1, "same words", "b", "s"), (2, "same words", "a", "s"), (None, "same words", None, None)])
    model = language_id.train(d)
    assert {r["lang_pred"] for r in language_id.predict(spark, d, model, "text", F.col("doc_id"), F.col("text"), F.col("text").alias("_text")).collect()} == {"a"}
    with pytest.raises(ValueError):
        language_id.predict(spark, d, model, "text", F.col("lang").alias("Score"))


def test_language_training_bound(spark, corpus):
    d = docs_of(spark, corpus)
    assert set(language_id.train(d, max_train=40)[0]) <= {"de", "en", "fr"}


# ------------------------------------------------------------------ 2

def brute_lines(rows):
    seen, dels, out = set(), defaultdict(set), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}):
        keep = []
        for line in t.split("\n"):
            x = line.strip()
            if not x:
                keep.append(line)
                continue
            if x not in seen:
                near = any(x[:k] + x[k + 1:] in seen for k in range(len(x))) or bool(dels.get(x)) or any(k in dels.get(x[:k] + x[k + 1:], ()) for k in range(len(x)))
                seen.add(x)
                for k in range(len(x)):
                    dels[x[:k] + x[k + 1:]].add(k)
                if not near:
                    keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_lines(spark, corpus):
    rows = [x for x in corpus if x[0] != 2 or x[3] != "s2"]
    rows = [(i, t if i not in (115, 116) else "y" * 300, la, s) for i, t, la, s in rows]
    rows += [(200, "abcdefgh line\nabcdefg line\nabXdefgh line\nzzz", "en", "a"), (201, "abcdefghi line\nzzza\nzz\nqqqq", "en", "a"), (202, "ü-line with é\nü-line with e\nz", "en", "a")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark, docs_of(spark, rows)).collect()}
    want = brute_lines(rows)
    assert {i: got[i]["text"] for i in want} == want
    assert got[110]["text"] is None and got[110]["_ld_dropped"] == 0
    assert len(got) == len({i for i, *_ in rows})
    assert line_dedup.dedup_lines(spark, docs_of(spark, rows[:1]).where("false")).count() == 0


def test_repeated_rows_keep_their_lines(spark):
    got = line_dedup.dedup_lines(spark, docs_of(spark, [(1, "same line here", "en", "a")] * 3 + [(None, "a line of nobody", None, None)])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == {(1, "same line here"): 3, (None, "a line of nobody"): 1}


def test_lines_of_null_ids_come_first(spark):
    rows = [(None, "a line that null holds", "en", "s"), (1, "a line that null holdz", "en", "s"), (2, "a line that null holds", "en", "s")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, docs_of(spark, rows)).collect()}
    assert got == {None: "a line that null holds", 1: "", 2: ""}


def test_very_long_lines_are_compared_in_a_band(spark):
    r = random.Random(6)
    line = "".join(r.choice("abcdefgh ") for _ in range(60_000)).strip()
    changed, cut, twice = line[:30_000] + "#" + line[30_001:], line[:41_000] + line[41_001:], "#" + line[1:-1] + "#"
    rows = [(1, line, "en", "s"), (2, changed, "en", "s"), (3, cut, "en", "s"), (4, twice, "en", "s")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, docs_of(spark, rows)).collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4)] == [len(line), 0, 0, len(twice)]


# ------------------------------------------------------------------ 3

@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing(spark, corpus, tokenizer):
    from tokenizers import Tokenizer

    rows = corpus + [(300, "It's 42 o'clock — naïve <|endoftext|> café… x", "en", "a"), (None, "nobody", None, None)]
    got = packing.pack(spark, docs_of(spark, rows), tokenizer).collect()
    t = Tokenizer.from_file(tokenizer)
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack(spark, docs_of(spark, rows[:1]).where("false"), tokenizer).count() == 0


@pytest.mark.parametrize("form", ["{0}", "A{0}B,{0} a.{0}", "ab{0}cd {0}x y{0}, z{0}. {0}"])
def test_tokens_of_every_letter_and_mark(tokenizer, form):
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    t, fast = Tokenizer.from_file(tokenizer), packing.WordTokenizer(tokenizer)
    every = [c for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] in "LMNPSZ" and not 0x4E00 <= ord(c) < 0x9F00 and not 0xAC00 <= ord(c) < 0xD700]
    for i in range(0, len(every), 4000):
        texts = [form.format(c) for c in every[i:i + 4000]]
        want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        got = [x.tolist() for x in fast.texts(pa.array(texts))]
        assert got == want


def test_tokens_do_not_depend_on_company(tokenizer):
    import pyarrow as pa

    fast = packing.WordTokenizer(tokenizer)
    texts = ["one, two.", None, "", " \n", "x.y,z", "café, naïve.", "क़ख़", "<|endoftext|>", "one," * 50]
    together = [x.tolist() for x in fast.texts(pa.array(texts))]
    assert together == [next(iter(fast.texts(pa.array([t], pa.string())))).tolist() for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    r = np.random.default_rng(seed)
    lengths = np.concatenate([r.integers(1, 2049, 300), r.integers(1, 40, 500), np.full(200, 700), np.full(seed * 50, 2048)])
    h = np.bincount(lengths, minlength=2049)
    runs, used = packing.plan(h, 2048)
    room = Counter()
    for v, rr in runs.items():
        assert rr[0][0] == 0
        ends = [*rr[1:, 0], h[v]]
        for (r0, base, off), end in zip(rr.tolist(), ends, strict=True):
            for k in range(int(end) - r0):
                room[base + k] += v
                assert off + v <= 2048
    assert sum(room.values()) == lengths.sum() and max(room.values()) <= 2048 and len(room) == used
    bins: list[int] = []  # first fit, longest first
    for v in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, room_left in enumerate(bins) if room_left >= v), None)
        if k is None:
            bins.append(2048 - v)
        else:
            bins[k] -= v
    assert used <= len(bins) * 1.01 + 1


# ------------------------------------------------------------------ 4 and 10

VECS = "vec_id long, embedding array<float>, label int, rep string, id int"


def vectors(seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(25, 16))
    rows = []
    for i in range(300):
        v = base[i % 25] + r.normal(size=16) * (0.05, 0.25, 0.6)[i % 3]
        rows.append((i, [float(np.float32(x)) for x in v], i % 4 if i % 11 else None))
    rows += [(i, rows[7][1], rows[7][2]) for i in range(300, 340)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] + [0.0] * 14, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [0.0] * 15, 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (None, rows[0][1], 0), (1, rows[1][1], rows[1][2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 9) for i, v, la in rows], VECS).repartition(3)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_vectors(spark):
    rows = vectors()
    got = vector_dedup.near_vectors(spark, frame(spark, rows), threshold=0.93).collect()
    up = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    use = [(k, i, np.array(v, float), la) for k, (i, v, la) in enumerate(rows) if i is not None and la is not None and good(v) and any(v)]
    for a, (k, i, v, la) in enumerate(use):
        for m, j, w, lb in use[:a]:
            if la == lb and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.93:
                links[k] += 1
                links[m] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    want = Counter((i, links[k], find(i) if i is not None else None, i is None or find(i) == i) for k, (i, *_) in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want
    assert sum(links.values()) > 500
    assert vector_dedup.near_vectors(spark, frame(spark, rows[:1]).where("false")).count() == 0


@pytest.mark.parametrize("few", [2, 100])
def test_tiles_of_cells(spark, monkeypatch, few):
    """Small tiles: every link is found, and most pairs of tiles go before their vectors are shipped."""
    monkeypatch.setattr(vector_dedup, "TILE", 8)
    monkeypatch.setattr(vector_dedup, "FEW", few)
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 12)) * np.exp(-np.arange(12) / 3)
    rows = [(i, [float(x) for x in base[i % 40] + r.normal(size=12) * 0.08], i % 2) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    hit = (x @ x.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2) & ~np.eye(400, dtype=bool)
    got = {y["vec_id"]: y["n_links"] for y in vector_dedup.near_vectors(spark, d, threshold=0.93).collect()}
    assert got == dict(enumerate(hit.sum(1).tolist()))
    good_rows = d.select(F.col("label"), F.col("embedding").alias("vec"), F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.xxhash64("vec_id").alias("uid"))
    sent = spark.sparkContext.broadcast({12: np.linalg.eigh(x.T @ x)[1][:, ::-1]})
    placed = vector_dedup.in_cells(good_rows, good_rows.select("label", F.lit(True).alias("large")).distinct(), sent, 0.93).withColumn("tile", F.concat_ws(":", "cell", F.lit(0)))
    tiles = placed.select("label", "tile").distinct().groupBy("label").count().collect()
    assert vector_dedup.tile_pairs(placed, 0.93).count() < 0.6 * sum(t["count"] * (t["count"] + 1) / 2 for t in tiles)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_tiles_find_all_links(n):
    r = np.random.default_rng(n)
    a, b = (np.repeat(r.normal(size=(n, 48)), 3, 0) + r.normal(size=(3 * n, 48)) * 0.2 for _ in range(2))
    b[: len(b) // 2] = a[: len(b) // 2] * 3 + 0.01
    i, j = vector_dedup.linked_pairs(a, b, np.linalg.eigh(a.T @ a)[1][:, ::-1], 0.93, False)
    s = vector_dedup.unit(a) @ vector_dedup.unit(b).T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(s >= 0.93)), strict=True))


def test_top_k(spark):
    rows = vectors() + [(500 + i, [0.5] * 16, 1) for i in range(30)]  # ties
    got = exact_topk.top_k(spark, frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    ints = {}
    for i, v, _ in rows:
        if i is not None and good(v):
            ints.setdefault(i, []).append(np.floor(64 * np.array(v)).astype(int))
    want = set()
    for q, vs in ints.items():
        if q % 20 == 0:
            s = sorted(((-max(int(vs[0] @ c) for c in cs), i) for i, cs in ints.items() if i != q and len(cs[0]) == len(vs[0])))[:20]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = exact_topk.top_k(spark, frame(spark, rows[:5]), F.col("vec_id") % 20 == 0, k=20).collect()
    assert len(few) == 4
    assert exact_topk.top_k(spark, frame(spark, rows[:5]).where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_queries(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=16)], 1) for i in range(200)]
    rows += [(i, rows[i][1], 1) for i in (0, 20, 20, 33, 33)]
    got = exact_topk.top_k(spark, frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    ints = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows}
    want = {(q, k + 1, i, -x) for q in range(0, 200, 20) for k, (x, i) in enumerate(sorted((-int(ints[q] @ c), i) for i, c in ints.items() if i != q)[:20])}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e12, 3.0], 1), (20, [1e300, 1.0], 1), (1, [1e12, 5.0], 1), (2, [1.0, 1.0], 1), (3, [-1e12, 0.0], 1), (4, [1e308, 1.0], 1), (5, [2.0**30, 1.0], 1)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in exact_topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, k=20).collect()}
    held = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    ints = {i: [int(64 * x // 1) for x in v] for i, v, _ in rows if i != 4}  # 4 leaves the range of doubles when scaled
    assert got == {(q, i): held(ints[q][0] * ints[i][0] + ints[q][1] * ints[i][1]) for q in (0, 20) for i in ints if i != q}


@pytest.mark.parametrize("skew", [0.0, 1.5])
def test_cutoffs_save_products_and_lose_nothing(skew):
    r = np.random.default_rng(4)
    scale = np.exp(-skew * np.arange(32) / 8)
    c = np.floor(r.normal(size=(3000, 32)) * scale * 64 * np.exp(r.normal(size=(3000, 1)) * skew))
    q, cid, qid = c[:40], np.arange(3000), np.arange(40)
    full = (q @ c.T).astype(np.int64)
    np.fill_diagonal(full[:, :40], np.iinfo(np.int64).min)
    cut = np.sort(full, 1)[:, -20]
    i, j, s = exact_topk.local_lists(qid, q, cid, c, 20)
    own = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    cuts = exact_topk.edges(32)
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):  # every slice's list is there
        p = q[:, at:end] @ c[:, at:end].T
        np.fill_diagonal(p[:, :40], -np.inf)
        assert all((x, int(y)) in own for x in range(40) for y in np.argsort(-p[x])[:20] if p[x, y] > np.sort(p[x])[-21])
    for x in range(40):
        assert np.sort(s[i == x])[-20] <= cut[x] and (full[x, j[i == x]] == s[i == x]).all()
    work = [0]
    i, j, s = exact_topk.sufficient(qid, q, cut, cid, c, work)
    assert {(a, b, v) for a, b, v in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)} == {(a, b, full[a, b]) for a, b in zip(*np.nonzero(full >= cut[:, None]), strict=True)}
    assert work[0] < q.size * len(c) * (1.0 if not skew else 0.4)


# ------------------------------------------------------------------ 5

def test_shards(spark, corpus):
    import hashlib

    limit = 4000
    got = sharding.shards(spark, docs_of(spark, corpus), limit=limit).collect()
    key = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, *_ in corpus}
    size = Counter()
    for i, t, *_ in corpus:
        size[i] += len((t or "").encode())

    def where(i):
        for d in range(61):
            own = [j for j in size if key[j] >> (60 - d) == key[i] >> (60 - d)]
            if sum(size[j] for j in own) <= limit or len({key[j] for j in own}) == 1:
                return d, key[i] >> (60 - d), sum(size[j] for j in own)

    assert len(got) == len(corpus)
    for r in got:
        d, s, b = where(r["doc_id"])
        assert (r["depth"], r["shard"], r["shard_bytes"], r["fits"]) == (d, s, b, b <= limit)
    assert sharding.shards(spark, docs_of(spark, corpus[:1]).where("false")).count() == 0


# ------------------------------------------------------------------ 6

def test_mix(spark, corpus):
    import hashlib

    got = mixing.mix(spark, docs_of(spark, corpus)).collect()
    size = [len(WORD.findall(t or "")) for _, t, *_ in corpus]
    total = Counter()
    for n, (_, _, _, s) in zip(size, corpus, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, free = 1.5 * sum(size), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else weight[s] * share
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    want = Counter()
    for s in order:
        u = int(hashlib.md5((s or "").encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / total[s] if total[s] else 0.0
        own = sorted((n, i) for n, (i, _, _, x) in zip(size, corpus, strict=True) if x == s)
        taken = 0
        for k, (n, i) in enumerate(own, 1):
            c = min(2, math.floor(rate * k + u) - math.floor(rate * (k - 1) + u))
            want[i, s, n, total[s], round(target[s], 6), n * c] += 1
            taken += n * c
        assert abs(taken - target[s]) <= max(n for n, _ in own) + 1e-6
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    d = docs_of(spark, corpus)
    out = mixing.mixed_documents(spark, d)
    assert out.columns == d.columns
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == +copies
    assert mixing.mix(spark, docs_of(spark, corpus[:1]).where("false")).count() == 0


# ------------------------------------------------------------------ 7

def brute_near(rows, k, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, corpus, k):
    r = random.Random(8)
    base = prose(r, 120).split(" ")
    rows = list(corpus)
    for i in range(400, 425):  # a family on both sides of the threshold
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.random()}"
        rows.append((i, " ".join(w), "en", "s"))
    got = minhash_dedup.near_duplicates(spark, docs_of(spark, rows), k=k).collect()
    want = brute_near(rows, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert len(got) == len(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f g", None, None), (1, "q r s t u v w", None, None), (2, "q r s t u v w", None, None), (3, "A b c d e f G", None, None), (None, "a b c d e f g", None, None), (4, None, None, None), (5, "", None, None)]
    got = minhash_dedup.near_duplicates(spark, docs_of(spark, rows), k=4).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, None, True): 1, (4, 4, True): 1, (5, 5, True): 1}
    assert minhash_dedup.near_duplicates(spark, docs_of(spark, rows).where("false")).count() == 0
    d = docs_of(spark, rows)
    assert minhash_dedup.one_per_group(spark, d, k=4).columns == d.columns


def test_near_duplicates_of_ids_with_several_texts(spark):
    r = random.Random(11)
    a, b = prose(r, 60).split(" "), prose(r, 60).split(" ")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(7, " ".join(a), None, None), (7, " ".join(b), None, None), (9, near(a), None, None), (3, near(b), None, None), (8, " ".join(b), None, None), (5, prose(r, 60), None, None)]
    got = minhash_dedup.near_duplicates(spark, docs_of(spark, rows), k=4).collect()
    assert Counter((x["doc_id"], x["component_id"]) for x in got) == {(7, 3): 2, (9, 3): 1, (3, 3): 1, (8, 3): 1, (5, 5): 1}


def test_families_without_their_square(spark, monkeypatch):
    """Many documents that share bands without being near, and some near ones that no centre meets, in small blocks."""
    monkeypatch.setattr(minhash_dedup, "WIDE", 16)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    r = random.Random(12)
    base = prose(r, 150).split(" ")
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(3, 9)):
            w[r.randrange(len(w))] = f"e{r.random()}"
        rows.append((i, " ".join(w), None, None))
        if i % 3 == 0:
            w[r.randrange(len(w))] = f"f{r.random()}"
            rows.append((1000 + i, " ".join(w), None, None))
    got = minhash_dedup.near_duplicates(spark, docs_of(spark, rows), k=4).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in got} == brute_near(rows, 4)


def test_sketch_bound_holds():
    r = np.random.default_rng(1)
    limit = minhash_dedup.most_ones(0.8)
    for _ in range(60):
        both, own = r.integers(1, 1 << 62, 800).astype(np.uint64), r.integers(1, 1 << 62, 200).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, own[s]])) for s in (slice(0, 100), slice(100, 200)))
        x, y = (minhash_dedup.odd_sketch(minhash_dedup.min_samples(v)) for v in (a, b))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= limit


# ------------------------------------------------------------------ 8

def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        w = prose(r, r.randint(5, 60)).split(" ")
        bad = i % 4 == 0
        if bad:
            w.insert(r.randrange(len(w) + 1), r.choice(["clown", "trash,", "Loser"]))
        rows.append((i, " ".join(w), "en" if i % 2 else None, "s"))
        labels.append((i, 1, int(bad)))
    rows += [(800, None, "en", "s"), (801, "", "en", "s"), (802, "?!", "en", "s"), (803, "x " * 50000, "en", "s"), (1, rows[1][1], "en", "s")]
    labels += [(900, 1, 1), (5, 1, None), (None, 1, 1)]
    d, la = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, limits = toxicity.train(d, la.where("doc_id % 3 <> 1"))
    got = {r[0]: r["score"] for r in toxicity.score(spark, d, model, "text", F.col("doc_id"), F.col("rank")).collect()}
    held = [i for i in range(700) if i % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[800] == got[801] == got[802] and set(limits) == {"", "en"}
    none, _ = toxicity.train(d, la.where("false"))
    assert none == 0.0
    assert {r["score"] for r in toxicity.score(spark, d, none, "text", F.col("doc_id")).collect()} == {0.0}
    assert toxicity.score(spark, d.where("false"), model, "text", F.col("doc_id")).count() == 0


def small_net(seed=1):
    net, r = toxicity.Net(seed), np.random.default_rng(seed)
    net.e = r.normal(0, 0.5, (toxicity.HASHES, toxicity.BUCKETS, toxicity.EMBED))
    net.w, net.v, net.c = [w.astype(float) for w in net.w], net.v.astype(float), np.array([0.1])
    return net


def test_convolution_matches_plain_loops():
    texts = [b"one two three four", b"", b"x", b"the cat, the dog"]
    ids, begin = toxicity.word_ids(texts)
    net = small_net()
    got, places = net.maxima(ids, begin, where=True)
    fast = toxicity.Net.__new__(toxicity.Net)
    fast.e, fast.w, fast.v, fast.c = net.e, net.w, net.v, net.c
    fast.prepare()
    assert np.allclose(fast.maxima(ids, begin)[0], got)
    for t in range(len(texts)):
        own = [sum(net.e[q][ids[i, q]] for q in range(toxicity.HASHES)) for i in range(begin[t], begin[t + 1])]
        col = 0
        for w in net.w:
            for f in range(toxicity.FILTERS):
                values = [sum(own[i + j] @ w[j][:, f] for j in range(len(w))) if i + len(w) <= len(own) else 0.0 for i in range(len(own))]
                assert got[t, col] == pytest.approx(max(values)) and values[places[t, col] - begin[t]] == pytest.approx(max(values))
                col += 1
    want = [1 / (1 + math.exp(-(sum(max(0.0, x) * v for x, v in zip(row, net.v, strict=True)) + 0.1))) for row in got]
    assert np.allclose(net.score(ids, begin), want)


def test_gradients_match_differences():
    texts, y = [b"one two three four", b"x y", b"the cat, the dog", b"one cat"], np.array([1.0, 0.0, 1.0, 0.0])
    ids, begin = toxicity.word_ids(texts)
    net = small_net()

    def loss():
        p = net.score(ids, begin)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    rows, pulls, dense = toxicity.gradients(net, ids, begin, y)
    r, eps = np.random.default_rng(0), 1e-6

    def slope(a, at):
        old = a[at]
        a[at] = old + eps
        up = loss()
        a[at] = old - eps
        down = loss()
        a[at] = old
        return (up - down) / (2 * eps)

    for a, g in zip([*net.w, net.v, net.c], dense, strict=True):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in a.shape)
            assert slope(a, at) == pytest.approx(g[at], abs=1e-6)
    for q in range(toxicity.HASHES):
        for bucket in r.choice(np.unique(ids[:, q]), 4):
            want = pulls[rows[:, q] == bucket].sum(0)
            d = int(r.integers(0, toxicity.EMBED))
            assert slope(net.e[q], (bucket, d)) == pytest.approx(want[d], abs=1e-6)


def test_toxicity_is_the_same_however_rows_come(spark):
    r = random.Random(3)
    rows = [(i % 80, prose(r, 12) + (" clown" if i % 4 == 0 else ""), "en", "s") for i in range(160)]  # ids with two texts
    la = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    models = [toxicity.train(docs_of(spark, x, p), la)[0] for x, p in ((rows, 1), (rows[::-1], 4))]
    assert all((a == b).all() for a, b in zip(models[0].w, models[1].w, strict=True))
    few = toxicity.train(docs_of(spark, rows), la, max_bytes=2000)
    assert few is not None
    with pytest.raises(ValueError):
        toxicity.score(spark, docs_of(spark, rows), models[0], "text", F.col("n_chars").alias("score"))


# ------------------------------------------------------------------ 9

def test_passages(spark, corpus):
    r = random.Random(4)
    p = prose(r, 55)
    rows = list(corpus) + [(500 + i, f"{prose(r, i * 9)} {p} {prose(r, 30)}", "en", "s") for i in range(8)] + [(600, p.upper(), "en", "s"), (601, " ".join(p.split(" ")[:49]), "en", "s"), (None, p, "en", "s")]
    got = suffix_dedup.repeated_passages(spark, docs_of(spark, rows)).collect()
    words = {i: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in rows if i is not None}
    at = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            at[tuple(w[k:k + 50])].add(i)
    cover = {i: np.zeros(len(w), bool) for i, w in words.items()}
    mine = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(at[tuple(w[k:k + 50])]) > 1:
                cover[i][k:k + 50] = True
    for r_ in got:
        assert r_["other_doc"] != r_["doc_id"] and r_["end_word"] - r_["start_word"] >= 50
        mine[r_["doc_id"]][r_["start_word"]:r_["end_word"]] = True
    for i in words:
        assert (cover[i] == mine[i]).all(), i
    assert 601 not in {x["doc_id"] for x in got}
    assert suffix_dedup.repeated_passages(spark, docs_of(spark, rows[:1]).where("false")).count() == 0


def test_passages_of_frequent_grams(spark):
    """Partners far apart among the rows of a gram, a document that repeats a passage, and two partners of one suffix."""
    r = random.Random(7)
    rows = []
    for _ in range(6):  # pairs of 55 words: 15 of their own, then a phrase of 40 that all of 16 documents hold
        phrase = prose(r, 40)
        for _ in range(8):
            own = prose(r, 15)
            rows += [f"{prose(r, 60)} {own} {phrase} {prose(r, 60)}" for _ in range(2)]
    p = prose(r, 50)
    rows += [" ".join(f"{p} {prose(r, 3)}" for _ in range(12)), f"{prose(r, 40)} {p} {prose(r, 40)}"]
    for _ in range(10):
        left, mid, right = prose(r, 30), prose(r, 20), prose(r, 30)
        rows += [f"{left} {mid} {right}", f"{left} {mid} {prose(r, 40)}", f"{prose(r, 40)} {mid} {right}"]
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in rows]
    at = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            at[tuple(w[k:k + 50])].add(i)
    want, got = ({i: np.zeros(len(w), bool) for i, w in enumerate(words)} for _ in range(2))
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            if len(at[tuple(w[k:k + 50])]) > 1:
                want[i][k:k + 50] = True
    for x in suffix_dedup.repeated_passages(spark, docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect():
        assert x["other_doc"] != x["doc_id"]
        got[x["doc_id"]][x["start_word"]:x["end_word"]] = True
    assert [i for i in want if (want[i] != got[i]).any()] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_recombined_blocks(spark, seed):
    """Documents made of the same few blocks in any order: alike rows of many documents, partners in part, and repeats within one document."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    r = random.Random(seed)
    blocks = [prose(r, r.choice([22, 28, 35, 45, 70])) for _ in range(9)]
    rows = [" ".join(r.choice([*blocks, prose(r, 15)]) for _ in range(r.randint(1, 6))) for _ in range(120)]
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in rows]
    at = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            at[tuple(w[k:k + 50])].add(i)
    want, got = ({i: np.zeros(len(w), bool) for i, w in enumerate(words)} for _ in range(2))
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            if len(at[tuple(w[k:k + 50])]) > 1:
                want[i][k:k + 50] = True
    for x in suffix_dedup.repeated_passages(spark, docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect():
        assert x["other_doc"] != x["doc_id"]
        got[x["doc_id"]][x["start_word"]:x["end_word"]] = True
    for k, v in old.items():
        spark.conf.set(k, v)
    assert [i for i in want if (want[i] != got[i]).any()] == [] and sum(w.sum() for w in want.values()) > 3000


# ------------------------------------------------------------------ 5, once more

def key_of(i):
    import hashlib

    return int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)


def test_only_oversized_buckets_split(spark):
    """A run of ids whose hashes share many bits, null ids, rows that repeat an id: depths differ, and only where bytes ask for it."""
    near = sorted(range(60_000), key=key_of)[:40]  # their hashes begin alike
    rows = [(i, "x" * 100, "en", "s") for i in [*near, *range(100_000, 100_200)]] + [(None, "y" * 90, "en", "s")] * 2 + [(5, "z" * 700, "en", "s")] * 2
    limit = 1000
    got = sharding.shards(spark, docs_of(spark, rows), limit=limit).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r["depth"], r["shard"]] += r["n_bytes"]
    depths = {r["depth"] for r in got}
    assert max(depths) - min(depths) >= 8
    for r in got:
        h = key_of(r["doc_id"])
        assert r["shard"] == h >> (60 - r["depth"]) and r["shard_bytes"] == size[r["depth"], r["shard"]] and r["fits"] == (r["shard_bytes"] <= limit)
        assert r["fits"] or len({key_of(x["doc_id"]) for x in got if (x["depth"], x["shard"]) == (r["depth"], r["shard"])}) == 1
        if r["depth"]:  # the bucket above did not fit
            above = sum(len(t) for i, t, *_ in rows if key_of(i) >> (61 - r["depth"]) == r["shard"] >> 1)
            assert above > limit
    assert {r["shard_bytes"] for r in got if r["doc_id"] == 5} == {1400} and {r["shard_docs"] for r in got if r["doc_id"] is None} <= set(range(2, 20))
    table = sorted(sharding.directory(sharding.shards(spark, docs_of(spark, rows), limit=limit)).collect(), key=lambda r: r["first_hash"])
    assert len(table) == len(size) and all(a["last_hash"] < b["first_hash"] for a, b in zip(table, table[1:], strict=False))
    assert all(sum(t["first_hash"] <= key_of(r["doc_id"]) <= t["last_hash"] for t in table) == 1 for r in got)


def test_the_query_splits_to_several_depths(spark):
    from skein.llm import queries

    assert len({r["depth"] for r in queries.op5_sharding(spark, "/root/testdata/sf0.01").select("depth").distinct().collect()}) >= 2


# ------------------------------------------------------------------ 8, as registered

def test_toxicity_query_quality(spark):
    from skein.llm import queries

    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in queries.op8_toxicity(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    yes, no = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    area = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert area >= 0.85 and sum(p for _, t, p in held if not t) <= 0.05 * len(no) and sum(p for _, t, p in held if t) >= 0.4 * len(yes)


# ------------------------------------------------------------------ rows that share an id

def test_passages_of_an_id_with_a_copy(spark):
    r = random.Random(12)
    a, b = prose(r, 80), prose(r, 60)
    rows = [(3, a, "en", "s"), (7, a, "en", "s"), (7, b, "en", "s"), (9, prose(r, 20) + " " + b + " " + prose(r, 20), "en", "s")]
    got = sorted(tuple(x) for x in suffix_dedup.repeated_passages(spark, docs_of(spark, rows)).collect())
    # the spans of both texts of 7 come together
    assert got == [(3, 0, 80, 7), (7, 0, 80, 3), (9, 20, 80, 7)]
    apart = sorted(tuple(x) for x in suffix_dedup.repeated_passages(spark, docs_of(spark, rows[1:])).collect())
    assert apart == [(7, 0, 60, 9), (9, 20, 80, 7)]


def test_vectors_of_many_lengths_and_labels(spark):
    r = np.random.default_rng(7)
    rows = []
    for label in range(60):
        for d in (3, 8, 5000) if label < 2 else (3, 8):
            v = r.normal(size=d)
            rows += [(len(rows), [float(x) for x in v], label), (len(rows) + 1, [float(x) for x in v * 2], label), (len(rows) + 2, [float(x) for x in -v], label)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {x["vec_id"]: tuple(x) for x in vector_dedup.near_vectors(spark, df).collect()}
    for i, v, label in rows:
        near = [j for j, w, other in rows if other == label and j != i and len(v) == len(w) and float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= 0.93]
        assert got[i][1] == len(near) and got[i][2] == min([i, *near])
