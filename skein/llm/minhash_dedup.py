"""MinHash near-dedup with odd sketches (Mitzenmacher, Pagh, Pham 2014).

Links documents whose sets of word shingles have a Jaccard similarity of at least `threshold`.

1. One pass over the texts: the shingle set's size and 128-bit fingerprint, BANDS x ROWS MinHash samples as band keys, and the
   samples folded into a parity bitmap (odd sketch) of BITS bits.
2. Documents of equal sets are one class, represented by its smallest id; copies are never expanded into pairs.
3. Representatives that share a band key are candidates. Two rounds compare a bucket's members with one of them (first each member with
   its smallest partner only, then each bucket with a centre drawn by a hash), so pairs grow with the members; members already known
   to be connected are left out. What is still apart goes to families (all that candidates reach), which are compared in blocks of
   BLOCK x BLOCK inside tasks: every pair of different components that shares a band is decided there, likeliest first, and a block
   returns a spanning forest of its links. So no link is lost, no bucket is capped, and rows never grow with a bucket's square.
4. A candidate pair whose sketches' XOR has too many ones cannot reach the threshold (odds below 1e-9) and is left out; all
   others are decided on their full sets.
5. Components by star contraction (common.components).

A pair at similarity 0.8 shares no band with a probability of (1 - 0.8^5)^40 = 1.3e-7; above 0.8 it is less.

Defined results: null or empty texts, or texts without words: set size 0, linked with nothing, kept. Fewer words than a shingle:
the whole sequence is the one shingle. Repeated rows with one id: each row is returned, all with that id's component; if their texts
differ, each of them is compared. Very long texts are compared whole. Empty tables give empty results. Null ids:
kept as they are, component null, kept true, linked with nothing. Any other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, Scratch, blocks_of, components, distinct, hash_words, mix, semi_join, shingles, sliced, small_rows, utf8, word_spans

BANDS, ROWS, BITS, BLOCK, WIDE = 40, 5, 1024, 512, 4096
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) << np.uint32(1)) | np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for i, j in blocks_of(texts):
        buf, starts, ends, first = word_spans(texts[i:j])
        hashes, begin = shingles(hash_words(buf, starts, ends), first, k)
        out += [distinct(hashes[begin[x]:begin[x + 1]]) for x in range(j - i)]
    return out


def min_samples(one: np.ndarray) -> np.ndarray:
    """BANDS x ROWS minima of random 32-bit permutations (odd multipliers; the hashes are random) of a non-empty set."""
    x = (one >> np.uint64(32)).astype(np.uint32) ^ one.astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    room = np.empty((min(256, len(x)), len(_A)), np.uint32)
    for i in range(0, len(x), 256):  # blocks that stay in cache
        part = x[i:i + 256, None]
        np.minimum(out, np.multiply(part, _A, out=room[: len(part)]).min(axis=0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bit = (mix(samples.astype(np.uint64) ^ _SALT) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def most_ones(threshold: float) -> int:
    """An XOR population count that pairs at the threshold pass but with odds of about 1e-9: six deviations above the mean.

    Of the samples, a binomial share 1 - threshold differs; each flips two of BITS bits, some of them back.
    """
    k = BANDS * ROWS
    ones = lambda differ: BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ))
    mean, spread = k * (1 - threshold), (k * threshold * (1 - threshold)) ** 0.5
    by_samples = ones(mean + spread) - ones(mean)
    by_folding = (2 * mean) / BITS**0.5 * 1.5
    return int(ones(mean) + 6 * (by_samples**2 + by_folding**2) ** 0.5 + 1)


_SKETCH = "id long, h long, n long, f1 long, f2 long, bands array<long>, sketch array<long>"


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            texts = utf8(batch.column(2).to_pylist())
            n, f1, f2, bands, sketch = [], [], [], [], []
            for one in shingle_sets(texts, k):
                if not len(one):
                    n.append(0), f1.append(None), f2.append(None), bands.append(None), sketch.append(None)
                else:
                    s = min_samples(one)
                    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for r in s.reshape(BANDS, ROWS).T:
                        keys = mix(keys ^ r.astype(np.uint64))
                    n.append(len(one))
                    f1.append(int(np.bitwise_xor.reduce(one).view(np.int64)))
                    f2.append(int(mix(one + np.uint64(12345)).sum().view(np.int64)))
                    bands.append(keys.view(np.int64))
                    sketch.append(odd_sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=["id", "h", "n", "f1", "f2", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(run, _SKETCH)


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """id and the sorted 64-bit hashes of its shingles, as bytes."""

    def run(batches):
        for batch in sliced(batches):
            sets = [s.tobytes() for s in shingle_sets(utf8(batch.column(1).to_pylist()), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def verified(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar: first by their sketches and sizes, then on their full sets."""
    percent = round(threshold * 1e6)

    def by_set(batches):
        for batch in sliced(batches, 8 << 20):
            a = np.asarray(batch.column(0))
            left, right = batch.column(2), batch.column(3)
            size_b = np.diff(np.frombuffer(right.buffers()[1], np.int32)[right.offset:right.offset + len(right) + 1]) // 8
            keep = np.zeros(len(a), bool)
            runs = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
            for i, j in zip(runs[:-1], runs[1:], strict=True):  # pairs of one a come together
                x = np.frombuffer(left[int(i)].as_buffer(), np.uint64)
                for s in range(i, j, 64):
                    e = min(j, s + 64)
                    y = np.frombuffer(b"".join(right[int(q)].as_py() for q in range(s, e)), np.uint64)
                    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    n = size_b[s:e]
                    both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
                    keep[s:e] = 1_000_000 * both >= percent * (len(x) + n - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    s = sketch.select("id", "n", "sketch")
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64)), F.lit(0))
    near = (
        pairs.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .where(F.least("na", "nb") * 1_000_000 >= F.greatest("na", "nb") * percent)
        .where(differ <= most_ones(threshold))
        .select("a", "b")
    )
    return (
        near.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
        .mapInArrow(by_set, "a long, b long")
    )


def likely_pairs(rows: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """rows (key, id, c): a spanning forest (a, b) of each bucket's pairs of different c that sketch and size let pass, for each pair of blocks."""
    percent, limit = round(threshold * 1e6), most_ones(threshold)
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks"))
    m = rows.join(size, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    m = m.join(sketch.select("id", "n", "sketch"), "id")
    # small buckets share a task's groups: one group for each of many slots, not for each bucket
    m = m.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b1", F.least("block", "u")).withColumn("b2", F.greatest("block", "u"))
    m = m.withColumn("lot", F.when(F.col("blocks") == 1, F.shiftrightunsigned(F.xxhash64("key"), 48)).otherwise(F.xxhash64("key", "b1", "b2")))

    def resolve(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        key, ids, c, n, block, b1, b2 = (np.asarray(t.column(x)) for x in ("key", "id", "c", "n", "block", "b1", "b2"))
        sk = np.array(t.column("sketch").to_pylist(), np.int64).reshape(len(ids), -1).view(np.uint64)
        order = np.lexsort((ids, b2, b1, key))
        k1 = key[order], b1[order], b2[order]
        starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in k1], axis=0), [True]]))
        out: tuple[list, ...] = ([], [])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            own = order[s:e]
            same = b1[own[0]] == b2[own[0]]
            rows_ = own if same else own[block[own] == b1[own[0]]]
            cols = own if same else own[block[own] != b1[own[0]]]
            place = {v: k for k, v in enumerate(own.tolist())}
            forest = Forest(len(own))
            for at in range(0, len(rows_), 64):
                i = rows_[at:at + 64]
                ok = (c[i][:, None] != c[cols][None, :]) & (np.minimum(n[i][:, None], n[cols][None, :]) * 1_000_000 >= np.maximum(n[i][:, None], n[cols][None, :]) * percent)
                x, y = np.nonzero(ok)
                x, y = i[x], cols[y]
                z = np.zeros(len(x), np.int64)
                for w in range(sk.shape[1]):
                    z += np.bitwise_count(sk[x, w] ^ sk[y, w])
                for a, b in zip(x[z <= limit].tolist(), y[z <= limit].tolist(), strict=True):
                    if forest.union(place[a], place[b]):
                        out[0].append(int(ids[a])), out[1].append(int(ids[b]))
        return pa.table([pa.array(o, pa.int64()) for o in out], names=["a", "b"])

    return m.groupBy("lot").applyInArrow(resolve, "a long, b long")


def family_links(members: DataFrame, family: DataFrame, sketch: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members (id, c) of one family (id, component) and different components c: a spanning forest for each pair of blocks."""
    percent, limit = round(threshold * 1e6), most_ones(threshold)
    m = members.join(family.withColumnRenamed("component", "family"), "id")
    size = m.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = m.join(size, "family").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    m = m.join(sketch, "id").join(sets, "id")
    m = m.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b1", F.least("block", "u")).withColumn("b2", F.greatest("block", "u"))

    def resolve(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, c, n, block = (np.asarray(t.column(x)) for x in ("id", "c", "n", "block"))
        bands, sk = (np.array(t.column(x).to_pylist(), np.int64) for x in ("bands", "sketch"))
        own = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        same = t.column("b1")[0].as_py() == t.column("b2")[0].as_py()
        rows = np.arange(len(ids)) if same else np.flatnonzero(block == t.column("b1")[0].as_py())
        cols = np.arange(len(ids)) if same else np.flatnonzero(block != t.column("b1")[0].as_py())
        left, right, ones = [], [], []
        for at in range(0, len(rows), 32):
            i = rows[at:at + 32]
            ok = c[i][:, None] != c[cols][None, :]
            ok &= np.minimum(n[i][:, None], n[cols][None, :]) * 1_000_000 >= np.maximum(n[i][:, None], n[cols][None, :]) * percent
            if same:
                ok &= i[:, None] < cols[None, :]
            x, y = np.nonzero(ok)
            x, y = i[x], cols[y]
            z = np.zeros(len(x), np.int64)
            for w in range(sk.shape[1]):
                z += np.bitwise_count((sk[x, w] ^ sk[y, w]).view(np.uint64))
            near = np.flatnonzero(z <= limit)
            near = near[(bands[x[near]] == bands[y[near]]).any(1)]
            left.append(x[near]), right.append(y[near]), ones.append(z[near])
        left, right, ones = map(np.concatenate, (left, right, ones)) if left else (np.zeros(0, int),) * 3
        place = {v: k for k, v in enumerate(np.unique(c).tolist())}
        of = [place[v] for v in c.tolist()]
        forest, out = Forest(len(place)), ([], [])
        for q in np.argsort(ones, kind="stable").tolist():
            i, j = int(left[q]), int(right[q])
            if forest.find(of[i]) == forest.find(of[j]):
                continue
            x, y = own[i], own[j]
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            if 1_000_000 * both >= percent * (len(x) + len(y) - both):
                forest.union(of[i], of[j])
                out[0].append(int(ids[i])), out[1].append(int(ids[j]))
        return pa.table([pa.array(o, pa.int64()) for o in out], names=["a", "b"])

    return m.groupBy("family", "b1", "b2").applyInArrow(resolve, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links), kept (id = component)."""
    tmp = Scratch(spark)
    all_rows = tmp.write(sketches(docs, id_col, text_col, k))
    rows = all_rows.where("n > 0 and id is not null")
    # a node is an id; where an id comes with several texts, a node is one of these texts
    several = tmp.write(rows.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("id", F.lit(True).alias("many")))
    plain = several.isEmpty()

    def with_node(df: DataFrame) -> DataFrame:
        if plain:
            return df.withColumn("node", F.col("id"))
        flag = F.broadcast(several) if small_rows(several) else several
        return df.join(flag, "id", "left").withColumn("node", F.when(F.col("many"), F.xxhash64("id", "h")).otherwise(F.col("id"))).drop("many")

    sets = with_node(rows)
    classes = tmp.write(sets.groupBy("f1", "f2", "n").agg(F.min("node").alias("rep")))  # apart from the join, so that a hot class can be split
    of = tmp.write(sets.select("id", "node", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("id", "node", "rep"))
    reps = of.where("node = rep").select("node").distinct()
    sketch = tmp.write(sets.join(reps, "node", "left_semi").groupBy(F.col("node").alias("id")).agg(F.first(F.struct("n", "bands", "sketch")).alias("x")).select("id", "x.*"))

    keys = sketch.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("of")).where("c > 1")
    one_each = shared.groupBy("c", "of", "low").agg(F.min("key").alias("key"))  # many bands have the same bucket
    buckets = tmp.write(keys.join(one_each.select("key"), "key").select("key", "id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text")).where("text is not null and id is not null")
    texts = with_node(texts).select(F.col("node").alias("id"), "text")
    texts = tmp.write(semi_join(texts, buckets.select("id").distinct(), "id").groupBy("id").agg(F.first("text").alias("text")))  # a node's texts are equal
    full = tmp.write(full_sets(texts, k))
    tmp.drop(texts)

    # first each member with its smallest partner
    low = buckets.groupBy("key").agg(F.min("id").alias("centre"))
    pairs = buckets.join(low, "key").where("id <> centre").groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a")).select("a", "b")
    first = tmp.write(verified(pairs, sketch, full, threshold))
    # whoever has the same partner (or the partner's partner) is connected
    known = first.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("p"))
    up = known.select(F.col("id").alias("p"), F.col("p").alias("pp"))
    known = known.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("c"))
    b = tmp.write(buckets.join(known, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c")))
    # then each bucket with a centre of its own
    live = b.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min_by(F.struct("id", "c"), F.xxhash64("id", "key")).alias("centre")).where("c1 < c2")
    live = tmp.write(live.select("key", F.col("centre.id").alias("centre"), F.col("centre.c").alias("cc")))
    pairs = b.join(live, "key").where("id <> centre and c <> cc").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
    second = tmp.write(verified(pairs.join(first, ["a", "b"], "left_anti"), sketch, full, threshold))
    links = first.unionByName(second)
    if not plain:  # the texts of one id belong together
        own = of.join(several, "id").select("id", "rep").distinct()
        low = own.groupBy("id").agg(F.min("rep").alias("a"))
        links = links.unionByName(own.join(low, "id").where("rep <> a").select("a", F.col("rep").alias("b")))
    comp = tmp.write(components(links, tmp))
    # then what is still apart: buckets that hold several components besides their centre, which all others have met
    c = b.join(live.select("key", "centre"), "key").where("id <> centre").select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    apart = c.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("id").alias("low")).where("c1 < c2").select("key", "low")
    rest = tmp.write(c.join(apart, "key"))
    if not rest.isEmpty():
        likely = tmp.write(likely_pairs(rest.select("key", "id", "c"), sketch, threshold))
        family = tmp.write(components(likely, tmp))
        members = rest.select("id", "c").distinct().join(family.select("id"), "id", "left_semi")  # others have no likely partner
        links = links.unionByName(tmp.write(family_links(members, family, sketch, full, threshold)))
        comp = tmp.write(components(links, tmp))

    group = of.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id")).distinct()
    if not plain:  # named by its smallest id, not by its smallest node
        names = tmp.write(group.groupBy("component_id").agg(F.min("id").alias("name")))
        group = group.join(names, "component_id").select("id", F.col("name").alias("component_id")).distinct()
    out = all_rows.select("id", "n").join(group, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return tmp.finish(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def one_per_group(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without all but the first document of each group of near copies."""
    gone = near_duplicates(spark, docs, id_col, text_col, k, threshold).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(F.broadcast(gone) if small_rows(gone) else gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
