"""Language identification by hyperdimensional profiles (Joshi, Halseth, Kanerva 2016).

Every letter of any script, and the word boundary, has a random vector of +1 and -1 in DIM dimensions, made from its code point by a
seeded hash; capitals share their small letter's. A trigram is bound by multiplying its symbols' vectors, permuted by their place (two,
one and no cyclic shifts). A text's vector bundles its trigrams' vectors, one for each occurrence. A language's prototype bundles those
of its training texts, each text scaled to unit length; what all prototypes share is taken off, so that cosines tell languages
apart. A text gets the language of the largest cosine; its score is that cosine, 0 at least.

Bundling is linear, so a text's trigrams are counted first and the counts multiplied with the trigrams' vectors, some texts and some
trigrams at a time. Whole texts are read in training and in prediction, and a text's result depends on that text alone, not on those
that share its batch. Training reads at most about `max_train` rows, chosen by a hash of the id; all rows with a language are read where there
are fewer. It sums whole numbers, so its result depends on no order; one vector for each language comes to the driver.

Defined results: null text or one without letters: `und`, score 0. No training rows: all `und`. Ties: the smaller language.
Repeated rows: one result each. Null ids: predicted, never trained on. Columns not asked for are not read; a kept column named like a
result (lang_pred, score) is refused with a ValueError, as the result would be ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix, sliced

DIM = 1024
SEED = np.uint64(0x5EED1D)
UNKNOWN = "und"
_BITS = np.uint64(21)  # of a code point
_LOW = np.uint64((1 << 21) - 1)

_letter: dict[int, int] = {}


def letter_of(code: int) -> int:
    """The small letter's code point; 0 for all that is no letter."""
    if code not in _letter:
        ch = chr(code)
        _letter[code] = ord(ch.lower()[0]) if not 0xD800 <= code < 0xE000 and ch.isalpha() else 0
    return _letter[code]


_ASCII = np.array([letter_of(c) for c in range(128)], np.uint32)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1, by a hash of seed and code point."""
    words = DIM // 64
    h = mix(mix(codes.astype(np.uint64) + SEED)[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(np.ascontiguousarray(h.astype("<u8")).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of packed trigrams (three code points)."""
    codes, at = np.unique(np.stack([grams >> (_BITS + _BITS), (grams >> _BITS) & _LOW, grams & _LOW]), return_inverse=True)
    letters = letter_vectors(codes)
    first, second, third = at.reshape(3, -1)
    return np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, packed trigram, count), by text and trigram; words are separated by one boundary."""
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _ASCII[np.minimum(cp, 127)].astype(np.uint64)
    high = np.flatnonzero(cp > 127)
    if len(high):
        codes, at = np.unique(cp[high], return_inverse=True)
        s[high] = np.array([letter_of(c) for c in codes.tolist()], np.uint64)[at]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(s)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (of[1:] != of[:-1])  # runs of other signs are one boundary
    s, of = s[keep], of[keep]
    s = np.concatenate([np.zeros(1, np.uint64), s, np.zeros(1, np.uint64)])
    mid = np.flatnonzero(s[1:-1] > 0) + 1
    gram, of = ((s[mid - 1] << _BITS | s[mid]) << _BITS) | s[mid + 1], of[mid - 1]
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])) if len(gram) else np.zeros(0, np.int64)
    return of[first], gram[first], np.diff(np.append(first, len(gram)))


def bundle(texts: list[str], lot: int = 4096) -> np.ndarray:
    """The texts' vectors (rows): whole numbers, exact in these floats up to 2^24 a coordinate."""
    of, gram, count = count_grams(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    grams, at = np.unique(gram, return_inverse=True)
    order = np.argsort(at, kind="stable")
    of, at, count = of[order], at[order], count[order]
    ends = np.searchsorted(at, np.arange(lot, len(grams) + lot, lot))
    i = 0
    for k, j in enumerate(ends.tolist()):
        c = np.zeros((len(texts), min(lot, len(grams) - k * lot)), np.float32)
        c[of[i:j], at[i:j] - k * lot] = count[i:j]
        out += c @ gram_vectors(grams[k * lot:k * lot + lot]).astype(np.float32)
        i = j
    return out


def text_blocks(texts: list[str], most_texts: int = 128, most_chars: int = 1 << 19):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < most_texts and (j == i or size + len(texts[j]) <= most_chars):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def unit(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.float64)
    return h / np.maximum(np.sqrt((h * h).sum(1, keepdims=True)), 1e-9)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 20_000) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes (rows of unit length)."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null")
    n = known.select("id").count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * max_train / n))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for i, j in text_blocks(texts):
                whole = np.rint(unit(bundle(texts[i:j])) * 1e6).astype(np.int64)  # whole millionths add up alike in any order
                for k in range(i, j):
                    sums[langs[k]] = sums.get(langs[k], 0) + whole[k - i]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM), pa.int32()), pa.array(v)], names=["lang", "d", "n"])

    rows = known.select("text", "lang").mapInArrow(run, "lang string, d int, n long").groupBy("lang", "d").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    if not langs:
        return [], np.zeros((0, DIM))
    p = np.zeros((len(langs), DIM))
    p[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["d"].to_numpy(int)] = rows["n"]
    p = unit(p)
    return langs, unit(p - p.mean(0)) if len(langs) > 1 else p


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", *keep: Column, unknown: str | None = UNKNOWN) -> DataFrame:
    """The columns `keep` with lang_pred and score; unknown: what texts without letters get, None where a language may have any name."""
    langs, prototypes = model
    sent = spark.sparkContext.broadcast(prototypes)  # languages x DIM floats

    def run(batches):
        p = sent.value
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            pred, score = [], []
            for i, j in text_blocks(texts):
                h = unit(bundle(texts[i:j]))
                cos = np.stack([p @ x for x in h]) if len(langs) else np.zeros((j - i, 1))  # text by text: the same in any company
                for some, x in zip(h.any(1), cos, strict=True):
                    ok = bool(some) and len(langs) > 0
                    k = int(np.argmax(x)) if ok else 0
                    pred.append(langs[k] if ok else unknown)
                    score.append(float(min(1.0, max(0.0, x[k]))) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*(f"c{k}" for k in range(batch.num_columns - 1)), "lang_pred", "score"])

    kept = docs.select(*keep)
    if {c.lower() for c in kept.columns} & {"lang_pred", "score"}:
        raise ValueError("lang_pred and score are names of results")
    plain = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))  # names of its own
    schema = StructType(plain.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")
    return plain.mapInArrow(run, schema).toDF(*kept.columns, "lang_pred", "score")
