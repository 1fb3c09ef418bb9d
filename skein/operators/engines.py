"""The connection engines, their registry, merging and scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import jaccard
from .vector_search import top_k_cosine

#: Default engine weights.
WEIGHTS = {"semantic_similarity": 0.25, "contradiction_detection": 0.40, "thematic_bridge": 0.35}

Engine = Callable[..., DataFrame]


class Registry:
    """Engines by name: fn(chunks, **options) -> edges (source, target, connection_type, strength)."""

    def __init__(self) -> None:
        self._engines: dict[str, Engine] = {}

    def register(self, name: str, engine: Engine) -> None:
        self._engines[name] = engine

    def get(self, name: str) -> Engine | None:
        return self._engines.get(name)

    def names(self) -> list[str]:
        return list(self._engines)

    def clear(self) -> None:
        self._engines.clear()

    def run(self, chunks: DataFrame, options: Mapping[str, Mapping] | None = None, engines: list[str] | None = None) -> DataFrame:
        """All engines' edges in one frame, the strongest of each (source, target, connection_type)."""
        out = None
        for name in engines or self.names():
            e = self._engines[name](chunks, **dict((options or {}).get(name, {})))
            out = e if out is None else out.unionByName(e)
        return out.groupBy("source", "target", "connection_type").agg(F.max("strength").alias("strength"))


def semantic_similarity(chunks: DataFrame, threshold: float = 0.7, k: int = 50, boost: float = 0.3, cross_document: bool = True) -> DataFrame:
    """Each current chunk's k nearest of other documents; importance lifts the strength, up to 1."""
    current = chunks.where("is_current and embedding is not null")
    found = top_k_cosine(current, current, k, threshold, other_document=cross_document)
    strength = F.least(F.lit(1.0), F.col("similarity") + boost * F.coalesce("importance", F.lit(0.0)))
    return found.join(current.select(F.col("id").alias("target"), "importance"), "target").select("source", "target", F.lit("semantic_similarity").alias("connection_type"), strength.alias("strength"))


def by_rarity(chunks: DataFrame) -> DataFrame:
    """id and its distinct concepts, lower-cased, the rarest first."""
    each = chunks.select("id", F.explode(F.array_distinct(F.transform("concepts", F.lower))).alias("concept"))
    often = each.groupBy("concept").agg(F.count("*").alias("n"))
    rows = each.join(often, "concept").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "concept"))).alias("c"))  # one chunk's concepts
    return rows.select("id", F.transform("c", lambda x: x["concept"]).alias("concepts"))


#: Sources of a concept that a task compares with targets at once.
TILE = 1024


class Sources:
    """A tile of sources of one concept, and the k best targets of each that have passed by."""

    def __init__(self, rows: pd.DataFrame, concept: str, k: int, min_overlap: float, min_distance: float):
        self.rows, self.concept, self.k, self.min_overlap, self.min_distance = rows, concept, k, min_overlap, min_distance
        self.at = {x: i for i, x in enumerate(sorted({x for own in rows["concepts"] for x in own}))}  # what only targets have is never common
        self.held, self.rarer, self.size = self._sets(rows)
        self.document, self.polarity, self.importance = (rows[c].to_numpy()[:, None] for c in ("document_id", "polarity", "importance"))
        self.strength, self.target = np.full((len(rows), k), -1.0), np.zeros((len(rows), k), np.int64)

    def _sets(self, rows: pd.DataFrame):
        """Which concepts rows have, which of them are rarer than this one, and how many they have."""
        held, rarer, size = np.zeros((len(rows), len(self.at)), np.float32), np.zeros((len(rows), len(self.at)), np.float32), np.zeros(len(rows))
        for r, own in enumerate(rows["concepts"]):
            own = list(own)
            size[r] = len(own)
            places = [self.at.get(x, -1) for x in own]
            held[r, [p for p in places if p >= 0]] = 1
            rarer[r, [p for p in places[:own.index(self.concept)] if p >= 0]] = 1
        return held, rarer, size

    def strengths(self, b: pd.DataFrame) -> np.ndarray:
        """Strengths of all pairs to nine places, -1 where they do not contradict or share a rarer concept (there they are met)."""
        held, rarer, size = self._sets(b)
        j = (self.held @ held.T).astype(np.float64)
        j /= self.size[:, None] + size[None, :] - j
        d = np.abs(self.polarity - b["polarity"].to_numpy()[None, :])
        ok = (j >= self.min_overlap) & (d >= self.min_distance) & (self.document != b["document_id"].to_numpy()[None, :]) & (self.rarer @ rarer.T == 0)
        s = np.minimum(1.0, 0.4 * j + 0.4 * (d / 2) + 0.2 * ((self.importance + b["importance"].to_numpy()[None, :]) / 2))
        return np.where(ok, np.floor(s * 1e9 + 0.5) / 1e9, -1.0)

    def meet(self, b: pd.DataFrame) -> None:
        """Targets in the order of their ids: of equals the earlier stays, so only what is better than a source's last counts."""
        s = self.strengths(b)
        better = s > self.strength[:, -1:]
        rows, cols = np.flatnonzero(better.any(1)), np.flatnonzero(better.any(0))
        if not len(rows):
            return
        both = np.hstack([self.strength[rows], s[np.ix_(rows, cols)]])
        ids = np.hstack([self.target[rows], np.broadcast_to(b["id"].to_numpy()[cols], (len(rows), len(cols)))])
        order = np.argsort(-both, axis=1, kind="stable")[:, :self.k]
        self.strength[rows], self.target[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)

    def best(self) -> pd.DataFrame:
        r, q = np.nonzero(self.strength >= 0)
        return pd.DataFrame({"source": self.rows["id"].to_numpy()[r], "target": self.target[r, q], "strength": self.strength[r, q]})


def contradiction(chunks: DataFrame, min_overlap: float = 0.5, min_distance: float = 0.3, k: int = 20) -> DataFrame:
    """Pairs that share concepts but differ in the sign of their polarity; strengths to nine places.

    A pair of similarity min_overlap has a concept in common among the rarest n - ceil(min_overlap * n) + 1 of each side, so only these are
    joined, and a common concept joins only chunks that have few rarer ones. Opposite signs join positive with negative rows only, so
    equal-signed pairs never arise. A concept's chunks are dealt to tiles of about TILE sources, so a concept of many chunks is many tasks; the targets
    pass by each tile as a sorted stream, and what leaves it is k rows for each source.
    """
    c = chunks.where("is_current").select("id", "document_id", "polarity", "importance")
    c = c.join(by_rarity(chunks.where("is_current")), "id")
    some = F.size("concepts") - F.ceil(min_overlap * F.size("concepts") - 1e-9).cast("int") + 1
    each = c.where("polarity <> 0").withColumn("concept", F.explode(F.slice("concepts", 1, some)))
    positive = F.col("polarity") > 0
    sizes = each.groupBy("concept").agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).where("p > 0 and n > 0")
    tiles = sizes.select("concept", F.ceil(F.col("p") / TILE).cast("int").alias("tp"), F.ceil(F.col("n") / TILE).cast("int").alias("tn"))
    dealt = each.join(tiles, "concept")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["concept", "id", "document_id", "polarity", "importance", "concepts"]
    sources = dealt.select(*cols, positive.alias("up"), F.when(positive, own("tp")).otherwise(own("tn")).alias("tile"), F.lit(0).alias("role"))
    targets = dealt.where(positive).select(*cols, F.lit(False).alias("up"), all_of("tn").alias("tile"), F.lit(1).alias("role"))
    targets = targets.unionByName(dealt.where(~positive).select(*cols, F.lit(True).alias("up"), all_of("tp").alias("tile"), F.lit(1).alias("role")))
    met = sources.unionByName(targets).repartition("concept", "up", "tile").sortWithinPartitions("concept", "up", "tile", "role", "id")

    def best(batches):
        """Tiles of sources, each followed by its targets by id: the k best of each source are kept as targets pass by."""
        tile = None  # (concept, up, tile)
        held: list[pd.DataFrame] = []  # the tile's sources, until its first target comes
        up: Sources | None = None
        for batch in batches:
            for key, part in batch.groupby(["concept", "up", "tile"], sort=False):
                if key != tile:
                    if up is not None:
                        yield up.best()
                    tile, held, up = key, [], None
                a, b = part[part["role"] == 0], part[part["role"] == 1]
                if len(a):
                    held.append(a)
                if len(b) and held:
                    up = up or Sources(pd.concat(held), key[0], k, min_overlap, min_distance)
                    up.meet(b)
        if up is not None:
            yield up.best()

    pairs = met.mapInPandas(best, "source long, target long, strength double")
    pairs = pairs.withColumn("strength", F.round("strength", 9))
    return best_per(pairs, "source", k, "strength", "target").select("source", "target", F.lit("contradiction_detection").alias("connection_type"), "strength")


def default_bridge_score(importance_a: Column, importance_b: Column, overlap: Column) -> Column:
    """Stand-in for a model's judgement: important chunks of different domains with concepts in common."""
    return F.least(F.lit(1.0), 0.7 * (importance_a + importance_b) / 2 + 0.3 * overlap)


def thematic_bridge(chunks: DataFrame, min_importance: float = 0.6, sources: int = 50, per_source: int = 10, min_strength: float = 0.6, score: Callable = default_bridge_score) -> DataFrame:
    """Bridges between important chunks of different documents and domains.

    The `sources` most important chunks (a fixed number, broadcast as such) each meet the `per_source` most important candidates.
    """
    c = chunks.where("is_current").where(F.col("importance") >= min_importance).select("id", "document_id", "domain", "importance", "concepts")
    top = c.orderBy(F.desc("importance"), "id").limit(sources)
    a = top.select(*[F.col(x).alias("a_" + x) for x in c.columns])
    met = F.broadcast(a).join(c, (F.col("a_document_id") != F.col("document_id")) & (F.col("a_domain") != F.col("domain")))
    met = best_per(met, "a_id", per_source, "importance", "id")
    strength = score(F.col("a_importance"), F.col("importance"), jaccard(F.col("a_concepts"), F.col("concepts")))
    return met.select(F.col("a_id").alias("source"), F.col("id").alias("target"), F.lit("thematic_bridge").alias("connection_type"), strength.alias("strength")).where(F.col("strength") >= min_strength)


def best_per(df: DataFrame, key: str, k: int, by: str, tie: str) -> DataFrame:
    """The k rows of each key with the largest `by`; Spark cuts each task's rows to k a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def registry() -> Registry:
    r = Registry()
    r.register("semantic_similarity", semantic_similarity)
    r.register("contradiction_detection", contradiction)
    r.register("thematic_bridge", thematic_bridge)
    return r


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old and new rows, the last of each key by `order` (rows of `new` win ties)."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_n"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def combine(scores: DataFrame, weights: Mapping[str, float], method: str = "average", normalize: str = "linear", keys: tuple[str, str] = ("target", "connection_type"), score: str = "strength") -> DataFrame:
    """Two-level aggregation: an engine's scores of a target are combined and normalised, then weighted over the engines present.

    method: sum (up to 1), average, max, harmonic_mean. normalize: linear, sigmoid (steepness 10 around 0.5), softmax.
    """
    s = F.col(score)
    how = {
        "sum": F.least(F.lit(1.0), F.sum(s)),
        "average": F.avg(s),
        "max": F.max(s),
        "harmonic_mean": F.when(F.min(s) <= 0, 0.0).otherwise(F.count(s) / F.sum(F.when(s > 0, 1 / s))),
    }[method]
    one = scores.groupBy(*keys).agg(how.alias("c"))
    c = F.col("c")
    n = {"linear": F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), "sigmoid": 1 / (1 + F.exp(-10 * (c - 0.5))), "softmax": F.exp(c) / (F.exp(c) + F.exp(1 - c))}[normalize]
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(keys[1])]
    out = one.withColumn("n", n).withColumn("w", F.coalesce(w, F.lit(0.0)))
    final = F.when(F.sum("w") > 0, F.sum(F.col("n") * F.col("w")) / F.sum("w")).otherwise(0.0)
    return out.groupBy(keys[0]).agg(final.alias("score"), F.count("*").alias("engines"), F.max_by(keys[1], F.struct(F.col("n") * F.col("w"), keys[1])).alias("top_engine"))
