"""Near-duplicate lines by deletion neighbourhoods (Mor and Fraenkel 1982; SymSpell), one edit.

A line (trimmed of white space; blank lines are left alone) is dropped where an earlier line, by (id, line number) of first occurrences, is equal
or within one insertion, deletion or substitution of a character. The earliest is kept.

1. Each line gives a 128-bit hash and, by the pigeonhole principle, four piece keys: two lines within one edit agree in the first or the
   last half of the shorter one. Equal lines become one (summed before the shuffle). Only lines that share a piece key go on; all
   others have no neighbour.
2. Those emit, for each shared piece, all variants of the rest of the line with one character less, and the rest itself, as hashed keys
   with the place of the deletion.
   Most variants are nobody else's: they are found by their 64-bit keys alone, and the rest made again with a second hash of the same
   characters, so that a collision of the first key hides no neighbour.
3. Equal variants are joined by aggregation: lines with the same variant and the same place differ by a substitution there, and a line that
   is the variant itself differs by one character from all who share it. So the earliest of each (variant, place) and of each
   variant shows whether a line has an earlier neighbour; no pairs are made within a variant, however many lines share it.
4. The edit distance of each line to be dropped and its earliest neighbour is verified on their texts, in a band of one edit: in proportion to
   a line's length. A line of n characters emits about 2n variants.

Defined results: null text stays null (no lines). Empty texts stay. Rows that repeat an id with the same text are one document: all stay alike.
Rows that repeat an id with another text come in the order of their texts' hashes. Null ids come first. Ties cannot occur. Empty tables
give empty results. All other columns are kept, whatever their names; only one named like the count asked for is replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULT, Scratch, mix, semi_join, sliced

#: Multipliers of the two hashes of a variant.
BASES = (MULT, np.uint64(0xA24BAED4963EE407))
_POWERS = [np.ones(1, np.uint64) for _ in BASES]
_BACK = [np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES]
VARIANTS = 1 << 16  # rows that a worker puts out at a time


def _long(b: bytes) -> int:
    return int.from_bytes(b, "little", signed=True)


def pieces(line: str) -> list[tuple[int, int, str]]:
    """(piece key, start of the rest, the rest) for the shorter length of a pair: the line's own, or one less."""
    n, out = len(line), []
    for m in (n, n - 1):
        if m < 1:
            continue
        half = m // 2
        for tag, piece, at, rest in ((0, line[:half], half, line[half:]), (1, line[n - (m - half):], 0, line[:n - (m - half)])):
            key = _long(hashlib.blake2b(f"{m},{tag},{piece}".encode("utf-8", "surrogatepass"), digest_size=8).digest())
            out.append((key, at, rest))
    return out


def powers(n: int, which: int) -> np.ndarray:
    """The first n powers of a base modulo 2^64."""
    if len(_POWERS[which]) < n:
        _POWERS[which] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), BASES[which])]), dtype=np.uint64)
    return _POWERS[which][:n]


def variants(rest: str, key: int, which: int = 0) -> np.ndarray:
    """Hashes of the rest without its i-th character, for each i, then of the rest itself; with the piece key."""
    c = np.frombuffer(rest.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(7)
    n = len(c)
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(c * powers(n, which), out=before[1:])  # sums of c[j] * base^j
    out = np.empty(n + 1, np.uint64)
    out[:n] = before[:n] + (before[n] - before[1:]) * _BACK[which]  # what follows moves one place down
    out[n] = before[n]
    size = np.full(n + 1, max(n - 1, 0), np.uint64)
    size[n] = n
    return mix(mix(out + np.uint64(key & ((1 << 64) - 1))) ^ size)


_LINES = "_ld_doc long, _ld_text long, line int, h1 long, h2 long, keys array<long>"


def lines_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in sliced(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            seen: dict[str, tuple] = {}
            for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, line in enumerate(text.split("\n") if text is not None else ()):
                    line = line.strip()
                    if not line:
                        continue
                    if line not in seen:
                        d = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        seen[line] = (_long(d[:8]), _long(d[8:]), [p[0] for p in pieces(line)])
                    for o, v in zip(out, (doc, text_hash, k, *seen[line]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["_ld_doc", "_ld_text", "line", "h1", "h2", "keys"])

    return docs.mapInArrow(run, _LINES)


def repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_ld_doc, _ld_text (hash of the text), drops (numbers of the lines to drop, from 0), for documents that have any."""
    tmp = Scratch(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("_ld_doc"), F.xxhash64(text_col).alias("_ld_text"), F.col(text_col).cast("string").alias("text"))
    lines = tmp.write(lines_of(keyed))
    place = F.struct("_ld_doc", "_ld_text", "line")
    distinct = tmp.write(lines.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    keys = distinct.select("h1", "h2", "at", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = tmp.write(keys.join(shared, "key").groupBy("h1", "h2", "at").agg(F.collect_set("key").alias("shared")))  # four keys at most

    wanted = live.groupBy(F.col("at._ld_doc").alias("_ld_doc"), F.col("at._ld_text").alias("_ld_text")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "h1", "h2", "shared")).alias("want"))
    wanted = tmp.write(wanted)
    texts = semi_join(keyed.where("text is not null"), wanted.select("_ld_text").distinct(), "_ld_text")  # by text: ids may be null
    texts = texts.join(wanted, (texts["_ld_doc"].eqNullSafe(wanted["_ld_doc"])) & (texts["_ld_text"] == wanted["_ld_text"])).select(texts["_ld_doc"], texts["_ld_text"], "text", "want").dropDuplicates(["_ld_doc", "_ld_text"])

    def own_lines(batches):
        for batch in sliced(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = text.split("\n")
                for w in want:
                    for o, v in zip(out, (w["h1"], w["h2"], w["shared"], parts[w["line"]].strip()), strict=True):
                        o.append(v)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["h1", "h2", "shared", "content"])

    content = texts.select("text", "want").mapInArrow(own_lines, "h1 long, h2 long, shared array<long>, content string")
    content = tmp.write(content.join(live.select("h1", "h2", "at"), ["h1", "h2"]))

    at_type = dict(distinct.dtypes)["at"]

    def emitted(second: bool):
        """Rows of content to rows of variants: the key alone, or all of it."""

        def put(out, owner):
            of, key, check, pos = map(np.concatenate, zip(*out, strict=True))
            for i in range(0, len(of), VARIANTS):
                j = slice(i, i + VARIANTS)
                if second:
                    yield pa.RecordBatch.from_arrays([*owner.take(pa.array(of[j])).columns, pa.array(key[j].view(np.int64)), pa.array(check[j].view(np.int64)), pa.array(pos[j])], names=["h1", "h2", "at", "variant", "check", "pos"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(key[j].view(np.int64))], names=["variant"])

        def run(batches):
            for batch in sliced(batches, 1 << 18):
                out, n = [], 0
                owner = batch.select(["h1", "h2", "at"]) if second else None
                for k, (shared_keys, line) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    for p, start, rest in pieces(line):
                        if p in shared_keys:
                            v = variants(rest, p)
                            check = variants(rest, p, 1) if second else v
                            out.append((np.full(len(v), k), v, check, np.append(np.arange(start, start + len(rest), dtype=np.int32), np.int32(-1))))
                            n += len(v)
                    if n >= VARIANTS:
                        yield from put(out, owner)
                        out, n = [], 0
                if out:
                    yield from put(out, owner)

        return run

    only_keys = content.select("shared", "content").mapInArrow(emitted(False), "variant long")
    several = tmp.write(only_keys.groupBy("variant").agg(F.count("*").alias("c")).where("c > 1").select("variant"))
    made = content.select("shared", "content", "h1", "h2", "at").mapInArrow(emitted(True), f"h1 long, h2 long, at {at_type}, variant long, check long, pos int")
    made = tmp.write(semi_join(made, several, "variant"))
    key = ["variant", "check"]
    row = F.struct("at", "h1", "h2")
    by_place = made.groupBy(*key, "pos").agg(F.min(row).alias("low"))
    whole = by_place.groupBy(*key).agg(F.min("low").alias("first"), F.min(F.when(F.col("pos") == -1, F.col("low"))).alias("self"))
    again = made.join(whole, key).join(by_place.select(*key, "pos", "low"), [*key, "pos"])
    earliest = F.least(F.when(F.col("pos") >= 0, F.col("low")), F.col("self"), F.when(F.col("pos") == -1, F.col("first")))
    near = again.select("h1", "h2", "at", earliest.alias("e")).where("e is not null and e.at < at").groupBy("h1", "h2").agg(F.min("e").alias("e"))
    text_of = content.select("h1", "h2", "content")
    near = near.join(text_of, ["h1", "h2"]).select("h1", "h2", F.col("content").alias("c1"), F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2"))
    near = near.join(text_of.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("content").alias("c2")), ["g1", "g2"])
    near = near.where(F.levenshtein("c1", "c2", 1) >= 0).select("h1", "h2", F.lit(True).alias("near"))

    many = distinct.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(tmp.write(many), ["h1", "h2"]).where(F.col("near") | (place != F.col("at")))
    return tmp.finish(gone.groupBy("_ld_doc", "_ld_text").agg(F.collect_set("line").alias("drops")))  # one document's lines


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "_ld_dropped") -> DataFrame:
    """docs with the repeated lines taken out of text_col, and count_col: how many."""
    gone = repeated_lines(spark, docs, id_col, text_col)
    names = [c for c in docs.columns if c.lower() != count_col.lower()]
    # rows travel as one column, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text_col).alias("hash"))
    text = F.col("row").getField(text_col).cast("string")
    out = rows.join(gone, rows["doc"].eqNullSafe(gone["_ld_doc"]) & (rows["hash"] == gone["_ld_text"]), "left")
    out = out.select("row", "drops", F.when(F.col("drops").isNotNull(), F.split(text, "\n")).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    rest = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    out = out.select("row", F.when(F.col("drops").isNotNull(), rest).otherwise(text).alias("text"), F.coalesce(F.size("drops"), F.lit(0)).alias("n"))
    cols = [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    return out.select(*cols, F.col("n").alias(count_col))
