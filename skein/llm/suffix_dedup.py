"""Repeated passages by sparse suffix arrays.

Finds passages of at least `least` words that a document shares with another document. Words are runs of anything but ASCII white space,
A-Z lower-cased.

1. Equal texts are one; each of them is a repeat of its whole length if that is enough.
2. The suffixes kept are those at minimisers: of every WINDOW consecutive K-word grams, the one of the smallest hash. K + WINDOW - 1 = 50, so
   two documents that share 50 words keep a suffix at the same word of the passage.
3. Suffixes whose gram no other document keeps are dropped (counts, summed before the shuffle). The others carry the 64-bit hashes of the words before
   and after their gram, as many as a passage of `least` words around it can need, and are sorted as suffixes: by gram, the words after it, then those
   before it.
4. Neighbours are compared, and the matches extended left and right word by word. Grams of up to GROUP rows stay in one task, so each of their rows meets
   all others. The suffixes of more frequent grams are range-partitioned by all their words, so that a gram of a third of all documents is many tasks;
   a row that is alike with a neighbour of another document in all its words gives that span. What is left of them, and the two ends of rows that are
   all alike, give the 50-word windows that they stand for (each window has one minimiser); the least and greatest document of each are aggregated before
   the shuffle, and windows that two documents hold are joined back. So no match is left out that neighbours do not show.
5. Matches of `least` words or more are merged into spans of each document.

Defined results: null or short texts: no spans. Rows that repeat an id with the same text: one document. Rows that repeat an id with other
texts: their spans come together under that id. Null ids: no spans. Repeats within one document alone are no spans.
other_doc is one of the documents that have the passage too. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, blocks_of, hash_words, mix, semi_join, sliced, small_rows, utf8, word_spans

LEAST, K, WINDOW, NEAR = 50, 20, 31, 4
GROUP = NEAR + 1  # rows of a gram of which all pairs lie within NEAR rows
SIDE = LEAST - K  # words before and after that a passage of LEAST words around a gram can need


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the K-grams of a row of words."""
    n = len(words) - K + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(K if n > 0 else 0):
        h = (h + words[j:n + j]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


def minimisers(h: np.ndarray) -> np.ndarray:
    """Places of the smallest hash (the first of equals) of each WINDOW."""
    if len(h) <= WINDOW:
        return np.array([int(np.argmin(h))]) if len(h) else np.zeros(0, np.int64)
    return np.unique(owners(h))


def owners(h: np.ndarray) -> np.ndarray:
    """Place of the minimiser of each window of LEAST words."""
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return view.argmin(1) + np.arange(len(view))


def _documents(texts: list[bytes]):
    """(number, word hashes) of each text of LEAST words or more."""
    for i, j in blocks_of(texts):
        buf, starts, ends, first = word_spans(texts[i:j])
        words = hash_words(buf, starts, ends)
        for k in range(j - i):
            if first[k + 1] - first[k] >= LEAST:
                yield i + k, words[first[k]:first[k + 1]]


def kept_suffixes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [])
            for k, words in _documents(utf8(batch.column(1).to_pylist())):
                h = gram_hashes(words)
                at = minimisers(h)
                out[0].append(np.full(len(at), ids[k], np.int64)), out[1].append(at.astype(np.int32)), out[2].append(h[at].view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["doc", "pos", "gram"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, pos int, gram long")


_SUFFIX = "gram long, doc long, pos int, n_before int, n_after int, before binary, after binary, low int, high int, hot boolean"


def with_context(docs: DataFrame) -> DataFrame:
    """docs (doc, text, few, many: arrays of positions) to one row per suffix with the words around its gram, nearest first; hot: of `many`.

    low and high: how many words before the gram the last and the first window begins whose minimiser the suffix is.
    """
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("n_before", pa.int32()), ("n_after", pa.int32()), ("before", pa.binary()), ("after", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("hot", pa.bool_())])

    def suffixes(doc, words, h, own, at, hot):
        pad = np.concatenate([np.zeros(SIDE, np.uint64), words, np.zeros(SIDE, np.uint64)])
        before = pad[at[:, None] + SIDE - 1 - np.arange(SIDE)]
        after = pad[at[:, None] + SIDE + K + np.arange(SIDE)]
        return h[at].view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32), np.minimum(at, SIDE).astype(np.int32), np.minimum(len(words) - K - at, SIDE).astype(np.int32), [x.tobytes() for x in before], [x.tobytes() for x in after], (at - np.searchsorted(own, at, "right") + 1).astype(np.int32), (at - np.searchsorted(own, at)).astype(np.int32), np.full(len(at), hot)

    def run(batches):
        for batch in sliced(batches, 1 << 20):
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = tuple([] for _ in schema)
            for k, words in _documents(utf8(batch.column(1).to_pylist())):
                h = gram_hashes(words)
                own = owners(h)  # grows with the window
                kept = np.unique(own)
                for column, hot in ((2, False), (3, True)):
                    at = np.intersect1d(np.asarray(batch.column(column)[k].values, np.int64), kept)  # a repeated id may bring another text's positions
                    if len(at):
                        for o, v in zip(out, suffixes(ids[k], words, h, own, at, hot), strict=True):
                            o.extend(v) if isinstance(v, list) else o.append(v)
            if out[0]:
                flat = [np.concatenate(out[c]) if c not in (5, 6) else out[c] for c in range(len(out))]
                for i in range(0, len(flat[0]), 1 << 12):  # 500 bytes a row
                    yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 12)], f.type) for c, f in zip(flat, schema, strict=True)], schema=schema)

    return docs.select("doc", "text", "few", "many").mapInArrow(run, _SUFFIX)


class _Rows:
    def __init__(self, batch):
        self.batch = batch
        self.gram, self.doc, self.pos, self.nb, self.na = (np.asarray(batch.column(c)) for c in range(5))
        self.low, self.high = (np.asarray(batch.column(c)) for c in ("low", "high"))
        read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SIDE)
        self.before, self.after = read(5), read(6)


def _equal(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of x and y, at most `most`."""
    same = (x == y) & (np.arange(SIDE) < most[:, None])
    return np.where(same.all(1), SIDE, same.argmin(1))


def _compare(r: _Rows):
    """Matches of suffixes up to NEAR rows apart: (row, words before, words after, other row)."""
    order = np.arange(len(r.gram))
    for d in range(1, NEAR + 1):
        i, j = order[:-d], order[d:]
        m = (r.gram[i] == r.gram[j]) & (r.doc[i] != r.doc[j])
        i, j = i[m], j[m]
        if len(i):
            b = _equal(r.before[i], r.before[j], np.minimum(r.nb[i], r.nb[j]))
            a = _equal(r.after[i], r.after[j], np.minimum(r.na[i], r.na[j]))
            ok = b + a + K >= LEAST
            yield i[ok], b[ok], a[ok], j[ok]
            yield j[ok], b[ok], a[ok], i[ok]


_SPAN = "doc long, start int, end int, other long"


def neighbours(batches):
    """Suffixes of a partition, sorted by gram, none split between partitions: each one's matches as one span, all hold its gram."""
    carry = None
    for batch in sliced(batches):
        table = pa.Table.from_batches([carry, batch] if carry is not None else [batch]).combine_chunks()
        batch = table.to_batches()[0]
        r = _Rows(batch)
        rows, starts, ends, others = [], [], [], []
        for i, b, a, j in _compare(r):
            rows.append(i), starts.append(r.pos[i] - b), ends.append(r.pos[i] + K + a), others.append(r.doc[j])
        if rows and sum(map(len, rows)):
            rows, starts, ends, others = map(np.concatenate, (rows, starts, ends, others))
            o = np.argsort(rows, kind="stable")
            rows, starts, ends, others = rows[o], starts[o], ends[o], others[o]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(r.doc[rows[first]]), pa.array(np.minimum.reduceat(starts, first).astype(np.int32)), pa.array(np.maximum.reduceat(ends, first).astype(np.int32)), pa.array(np.minimum.reduceat(others, first))], names=[x.split()[0] for x in _SPAN.split(", ")])
        carry = batch.slice(max(0, batch.num_rows - NEAR))


def owned_windows(r: _Rows, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, hash) of the windows of LEAST words whose minimiser is the suffix of each row, told apart by the words before and behind its gram."""
    n = len(rows)
    steps = np.arange(SIDE + 1)
    m = (steps >= r.low[rows][:, None]) & (steps <= r.high[rows][:, None])  # so many words before the gram, the rest behind it
    power = np.cumprod(np.full(SIDE, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = lambda x: np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(mix(x) * power, 1, dtype=np.uint64)], 1)
    before, after = sums(r.before[rows]), sums(r.after[rows])
    i, k = np.nonzero(m)
    h = mix(before[i, k] + mix(after[i, LEAST - K - k]) * np.uint64(0xC2B2AE3D27D4EB4F) + steps[k].astype(np.uint64))
    return rows[i], r.pos[rows[i]] - k.astype(np.int32), h


_FOUND = "doc long, start int, end int, other long, gram long, window long"


def hot_neighbours(batches):
    """Suffixes of frequent grams in their order: a row that matches a neighbour of another document in all words around its gram gives that span.

    The others, and the first and the last row of those that are all alike (at least two documents), give all windows that they stand for, so that each
    window is there for two documents if two have it.
    """
    carry, fresh = None, 0
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def settle(r: _Rows, first: int, end: int):
        """Rows first to end, compared with up to NEAR rows on either side."""
        other = np.full(len(r.gram), -1, np.int64)
        full = np.zeros(len(r.gram), bool)
        order = np.arange(len(r.gram))
        alike = (r.gram[1:] == r.gram[:-1]) & (r.nb[1:] == r.nb[:-1]) & (r.na[1:] == r.na[:-1]) & (r.before[1:] == r.before[:-1]).all(1) & (r.after[1:] == r.after[:-1]).all(1)
        of = np.concatenate([[0], np.cumsum(~alike)])[:len(r.gram)]  # rows that are all alike have one number
        at_end = ~(np.concatenate([[False], alike]) & np.concatenate([alike, [False]]))[:len(r.gram)]
        for d in range(1, NEAR + 1):
            i, j = order[:-d], order[d:]
            m = (of[i] == of[j]) & (r.doc[i] != r.doc[j]) & (r.nb[i] + r.na[i] + K >= LEAST)
            for x, y in ((i[m], j[m]), (j[m], i[m])):
                other[x] = np.where(full[x], np.minimum(other[x], r.doc[y]), r.doc[y])
                full[x] = True
        own = order[first:end]
        x = own[full[own]]
        if len(x):
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r.doc[x]), pa.array(r.pos[x] - r.nb[x]), pa.array((r.pos[x] + K + r.na[x]).astype(np.int32)), pa.array(other[x]), none, none], names=names)
        x = own[~full[own] | at_end[own]]
        for at in range(0, len(x), 1 << 11):
            i, start, h = owned_windows(r, x[at:at + (1 << 11)])
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(r.doc[i]), pa.array(start.astype(np.int32)), pa.array((start + LEAST).astype(np.int32)), pa.nulls(len(i), pa.int64()), pa.array(r.gram[i]), pa.array(h.view(np.int64))], names=names)

    for batch in sliced(batches):
        table = pa.Table.from_batches([carry, batch] if carry is not None else [batch]).combine_chunks()
        batch = table.to_batches()[0]
        end = max(fresh, batch.num_rows - NEAR)  # the last rows wait for those behind them
        yield from settle(_Rows(batch), fresh, end)
        cut = max(0, end - NEAR)
        carry, fresh = batch.slice(cut), end - cut
    if carry is not None and carry.num_rows > fresh:
        yield from settle(_Rows(carry), fresh, carry.num_rows)


def merge_spans(batches):
    for batch in sliced(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = None
            for s in sorted(spans, key=lambda x: (x["start"], x["end"], x["other"])):
                if now and s["start"] <= now[1]:
                    now[1], now[2] = max(now[1], s["end"]), min(now[2], s["other"])
                    continue
                if now:
                    for o, v in zip(out, (doc, *now), strict=True):
                        o.append(v)
                now = [s["start"], s["end"], s["other"]]
            for o, v in zip(out, (doc, *now), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], names=["doc_id", "start_word", "end_word", "other_doc"])


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_doc: the passages of LEAST words or more that other documents have too."""
    tmp = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    base = base.withColumn("h", F.md5(F.col("text").cast("binary")))
    named = base.select("doc", "h")
    groups = tmp.write(named.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high"))  # apart from the join, so that a hot text can be split
    copies = tmp.write(named.join(groups, "h").select("doc", "h", "low", "high").distinct())
    again = copies.where("doc <> low").select("doc", "h")  # rows, not ids: an id may have other texts
    single = base.join(F.broadcast(again) if small_rows(again) else again, ["doc", "h"], "left_anti").drop("h")

    sparse = tmp.write(kept_suffixes(single))
    shared = sparse.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low <> high").select("gram", (F.col("n") > GROUP).alias("hot"))
    shared = tmp.write(shared)  # apart from the join, so that its hot grams can be split
    places = lambda hot: F.collect_list(F.when(F.col("hot") == hot, F.col("pos")))
    at = tmp.write(sparse.join(shared, "gram").groupBy("doc").agg(places(False).alias("few"), places(True).alias("many")))
    texts = semi_join(single, at.select("doc"), "doc").join(at, "doc")
    suffixes = tmp.write(with_context(texts))
    order = ["gram", "after", "before", "doc", "pos"]  # suffix order: the gram stands for the first K words
    few = suffixes.where("not hot").drop("hot").repartition("gram").sortWithinPartitions(*order)
    spans = tmp.write(few.mapInArrow(neighbours, _SPAN))
    many = suffixes.where("hot").drop("hot").repartitionByRange(*order).sortWithinPartitions(*order)
    many = tmp.write(many.mapInArrow(hot_neighbours, _FOUND))
    # what no neighbour has shown: windows that two documents have
    spans = spans.unionByName(many.where("window is null").select("doc", "start", "end", "other"))
    windows = many.where("window is not null").select("gram", "window", "doc", F.col("start").alias("pos"))
    held = tmp.write(windows.groupBy("gram", "window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high"))
    wide = windows.join(held, ["gram", "window"])
    spans = spans.unionByName(wide.select("doc", F.col("pos").alias("start"), (F.col("pos") + LEAST).alias("end"), F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other")))
    n_words = F.regexp_count("text", F.lit(WORD)).cast("int")
    sizes = semi_join(base, copies.select("doc").distinct(), "doc").select("doc", "h", n_words.alias("end")).distinct()
    whole = copies.join(sizes, ["doc", "h"]).where(F.col("end") >= LEAST).select("doc", F.lit(0).alias("start"), "end", F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
    spans = spans.unionByName(whole)
    merged = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "other")).alias("s")).mapInArrow(merge_spans, "doc_id long, start_word int, end_word int, other_doc long")
    return tmp.finish(merged)
