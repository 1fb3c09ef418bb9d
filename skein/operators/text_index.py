"""A positional full-text index: postings (term, row, positions) as a table in the order of terms, boolean search with phrases and prefixes by positions.

Words are runs of letters and digits in small letters; a word's position counts all words. Stop words have no postings. Distinct words are stemmed once,
each, and brought back to the words by a join; nothing of the texts goes through Python. The table is range-partitioned by (term, row), so a frequent term
is many files, and lies in folders by the term's first letter: a search reads the folders and the row groups of its own terms and no other postings.
All terms of a search come from one scan and meet in one aggregation by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STOP, stem

WORDS = r"[\p{L}\p{N}]+"
#: Distinct words that are sent to all tasks; beyond, Spark joins by shuffle.
BROADCAST_WORDS = 500_000
_OWN_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Item:
    """A word, a prefix or a phrase: terms with their distances from the first."""

    terms: tuple[tuple[int, str], ...]
    prefix: bool = False


@dataclass(frozen=True)
class Clause:
    """Any of its items; negative: none of them."""

    items: tuple[Item, ...]
    negative: bool = False


def clauses(query: str) -> list[Clause]:
    """The clauses of a query as people type it: words (all of them), "phrases", -not, a or b, prefix*. Stop words are left out, but count in phrases."""
    out: list[Clause] = []
    either = False
    for sign, phrase, word, star in re.findall(r'(-?)(?:"([^"]*)"|([^\s"*]+)(\*?))', query):
        if word.lower() == "or" and not sign and not star:
            either = bool(out)
            continue
        words = _OWN_WORDS.findall((phrase or word).lower())
        kept = [(i, stem(w)) for i, w in enumerate(words) if w not in STOP]
        if not kept:
            continue
        item = Item(tuple((i - kept[0][0], t) for i, t in kept), bool(star))
        if either and not sign and not out[-1].negative:
            out[-1] = Clause((*out[-1].items, item))
        else:
            out.append(Clause((item,), bool(sign)))
        either = False
    return out


def cover_density(lists: list[list[int]]) -> float:
    """Sum over all smallest stretches that hold a position of each list of 1 / (1 + words between them); 0 if a list is empty."""
    if not lists or any(not len(x) for x in lists):
        return 0.0
    lists = [np.asarray(x) for x in lists]
    ends = np.unique(np.concatenate(lists))
    last = np.stack([np.searchsorted(x, ends, "right") - 1 for x in lists])
    full = (last >= 0).all(0)
    ends, last = ends[full], last[:, full]
    starts = np.min([x[k] for x, k in zip(lists, last, strict=True)], axis=0)
    first = np.concatenate([[True], starts[1:] != starts[:-1]])[:len(starts)]  # of equal starts only the first end is a smallest stretch
    return float(sum(1.0 / (1 + max(0, e - s + 1 - len(lists))) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)))


def moved(positions: str, by: int) -> Column:
    return F.transform(positions, lambda x: x - F.lit(by))


class TextIndex:
    """A written index: folder/postings by `head`, folder/rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.rows = folder, spark.read.parquet(f"{folder}/rows")
        self.keys = [c for c in self.rows.columns if c != "n_words"]
        kinds = dict(self.rows.dtypes)
        schema = ", ".join(["term string", *(f"`{c}` {kinds[c]}" for c in self.keys), "positions array<int>", "head string"])
        self.postings = spark.read.schema(schema).parquet(f"{folder}/postings")

    @staticmethod
    def build(rows: DataFrame, keys: list[str], text_col: str, folder: str) -> TextIndex:
        """Index the texts of rows, told apart by keys (all not null); a null text has no words. Rows that repeat a key are one row."""
        spark = rows.sparkSession
        words = F.expr(f"regexp_extract_all(lower(coalesce(`{text_col}`, '')), '{WORDS.replace(chr(92), chr(92) * 2)}', 0)")
        own = rows.select(*keys, words.alias("_words"))
        tokens = own.select(*keys, F.posexplode("_words").alias("_pos", "_word"))

        @F.pandas_udf("string")
        def term_of(s: pd.Series) -> pd.Series:
            return s.map(stem)

        # Stop words go before the distinct, by an expression: a condition on the term would be pushed below it, with the stemmer, which then sees every token.
        counted = tokens.where(~F.col("_word").isin(sorted(STOP)))
        counted.select("_word").distinct().select("_word", term_of("_word").alias("term")).write.parquet(f"{folder}/words")
        vocabulary = spark.read.parquet(f"{folder}/words")
        vocabulary = F.broadcast(vocabulary) if vocabulary.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else vocabulary
        head = F.substring("term", 1, 1)
        placed = counted.join(vocabulary, "_word").select(F.when(head.rlike("[a-z0-9]"), head).otherwise("_").alias("head"), "term", *keys, "_pos")
        by = ["head", "term", *keys]
        # Dealt out once, before they are grouped: ranges are found by a pass over the tokens, which costs less than one over grouped postings.
        postings = placed.repartitionByRange(*by).groupBy(*by).agg(F.sort_array(F.collect_set("_pos")).alias("positions"))  # a row's own words
        postings.select("term", *keys, "positions", "head").sortWithinPartitions(*by).write.partitionBy("head").parquet(f"{folder}/postings")
        own.groupBy(*keys).agg(F.max(F.size("_words")).alias("n_words")).write.parquet(f"{folder}/rows")
        return TextIndex(spark, folder)

    def read(self, items: list[Item]) -> DataFrame:
        """The postings of the items' terms."""
        exact = sorted({t for i in items if not i.prefix for _, t in i.terms})
        starts = sorted({t for i in items if i.prefix for _, t in i.terms})
        heads = sorted({t[0] if re.match("[a-z0-9]", t) else "_" for t in [*exact, *starts]})
        wanted = F.lit(False)
        if exact:
            wanted = wanted | F.col("term").isin(exact)
        for p in starts:
            wanted = wanted | F.col("term").startswith(p)
        return self.postings.where(F.col("head").isin(heads) & wanted)

    def search(self, query: str) -> DataFrame:
        """The keys of rows that the query holds for, and score: how near to each other the wanted words stand (0 if only words not to have were asked).

        A query without any word that counts finds nothing.
        """
        asked = clauses(query)
        items = [i for c in asked for i in c.items]
        if not items:
            return self.rows.select(*self.keys, F.lit(0.0).alias("score")).where(F.lit(False))
        names: dict[tuple[str, bool], str] = {}
        for i in items:
            for _, t in i.terms:
                names.setdefault((t, i.prefix), f"_p{len(names)}")
        columns = []
        for (t, prefix), name in names.items():
            if prefix:
                every = F.flatten(F.collect_list(F.when(F.col("term").startswith(t), F.col("positions"))))
                columns.append(F.sort_array(F.array_distinct(every)).alias(name))
            else:
                columns.append(F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), F.array().cast("array<int>")).alias(name))
        met = self.read(items).groupBy(*self.keys).agg(*columns)

        def places(i: Item) -> Column:
            """Where the item begins."""
            (_, first), *rest = i.terms
            at = F.col(names[first, i.prefix])
            for k, t in rest:
                at = F.array_intersect(at, moved(names[t, i.prefix], k))
            return at

        def has(c: Clause) -> Column:
            out = F.lit(False)
            for i in c.items:
                out = out | (F.size(places(i)) > 0)
            return out

        positive = [c for c in asked if not c.negative]
        for c in (c for c in asked if not c.negative):
            met = met.where(has(c))
        for c in (c for c in asked if c.negative):
            met = met.where(~has(c)) if positive else met.where(has(c))
        if not positive:
            return self.rows.join(met.select(*self.keys), self.keys, "left_anti").select(*self.keys, F.lit(0.0).alias("score"))

        @F.pandas_udf("double")
        def near(s: pd.Series) -> pd.Series:
            return s.map(lambda lists: round(cover_density([sorted(x) for x in lists]), 9))

        wanted = F.array(*(F.array_distinct(F.flatten(F.array(*map(places, c.items)))) for c in positive))
        return met.select(*self.keys, near(wanted).alias("score"))
