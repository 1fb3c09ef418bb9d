"""Documents of like structure: a similarity join of block sequences by bounds, with edit distances only for what the bounds leave.

The similarity of two fingerprints is 0.3 for their sequences (edit distance), 0.2 for depth, 0.25 for complexity and 0.25 for the share of block kinds
in common (chunking.fingerprint_similarity). At a threshold t no term may be short by more than 1 - t in all, which bounds each alone: lengths may
differ by a share of (1 - t) / 0.3, depths by 6 (1 - t) / 0.2, sets of kinds by a Jaccard distance of (1 - t) / 0.25.
1. Documents of equal sequence and depth are one class, represented by the smallest id; copies are never compared or expanded into pairs.
2. Classes lie in cells of (kinds, depth, logarithm of length). A class meets the classes of its own and of those neighbouring cells that the bounds allow.
3. Cells meet in tiles of TILE x TILE. The counts of each kind bound the edit distance of all pairs of a tile at once; only pairs whose bound reaches the
   threshold are compared by edit distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import edit_distance

TILE = 512
PAIRS = "a long, b long, similarity double, tried long"


def classes(fingerprints: DataFrame) -> DataFrame:
    """fingerprints (id, sequence: array of kinds, depth, complexity) to one row a class: rep, members, sequence, depth, complexity, kinds."""
    g = fingerprints.groupBy(F.array_join("sequence", "-").alias("_s"), "depth")
    c = g.agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.first("sequence").alias("sequence"), F.first("complexity").alias("complexity")).drop("_s")
    return c.withColumn("kinds", F.array_sort(F.array_distinct("sequence")))


def neighbours_of(sets: list[tuple[str, ...]], least: float) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """For each set the sets of a Jaccard similarity of `least` or more."""
    def like(a, b):
        x, y = set(a), set(b)
        return (len(x & y) / len(x | y) if x | y else 1.0) >= least - 1e-9

    return {a: [b for b in sets if like(a, b)] for a in sets}


def similar_structures(fingerprints: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a < b, similarity) at the threshold, with `tried`: how many pairs of the tile were compared by edit distance (on one row of the tile);
    and the classes.

    Ties and copies: a class stands for all documents of its sequence and depth, which are alike by definition. Thresholds of 0.7 or less are refused, as they
    bound no sequence.
    """
    if not 0.7 < threshold <= 1:
        raise ValueError("the threshold must be above 0.7")
    short = (1 - threshold) / 0.3
    c = classes(fingerprints)
    sets = [tuple(r["kinds"]) for r in c.select("kinds").distinct().collect()]  # sets of the few kinds of blocks there are
    near = neighbours_of(sets, 1 - (1 - threshold) / 0.25)
    spark = fingerprints.sparkSession
    to = spark.createDataFrame([(list(a), list(b)) for a, bs in near.items() for b in bs], "kinds array<string>, near array<string>")
    step = -math.log(max(1e-9, 1 - short)) + 1e-9
    bucket = F.when(F.size("sequence") > 0, F.floor(F.log(F.size("sequence").cast("double")) / F.lit(step))).otherwise(-1).cast("int")
    deep = math.floor(6 * (1 - threshold) / 0.2 + 1e-9)
    c = c.withColumn("bucket", bucket)
    row = ["rep", "sequence", "depth", "complexity"]
    right = c.select(*row, F.col("kinds").alias("cell_kinds"), F.col("depth").alias("cell_depth"), F.col("bucket").alias("cell_bucket"))
    left = c.join(F.broadcast(to), "kinds").select(*row, F.col("near").alias("cell_kinds"), F.explode(F.sequence(F.col("depth") - deep, F.col("depth") + deep)).alias("cell_depth"), "bucket")
    left = left.select(*row, "cell_kinds", "cell_depth", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("cell_bucket"))
    cell = ["cell_kinds", "cell_depth", "cell_bucket"]
    sized = right.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tr")).join(left.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tl")), cell)
    own = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spread = lambda df, x, y, side: df.join(sized, cell).withColumn("x", F.explode(x)).withColumn("y", F.explode(y)).withColumn("side", F.lit(side)).drop("tl", "tr")
    both = spread(left, own("tl"), all_of("tr"), 0).unionByName(spread(right, all_of("tl"), own("tr"), 1))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["side"] == 0], part[part["side"] == 1]
        none = pd.DataFrame({"a": [], "b": [], "similarity": [], "tried": []}).astype({"a": "int64", "b": "int64", "similarity": "float64", "tried": "int64"})
        if not len(a) or not len(b):
            return none
        names = {k: i for i, k in enumerate(sorted({k for s in part["sequence"] for k in s}))}
        texts = [["".join(chr(65 + names[k]) for k in s) for s in x["sequence"]] for x in (a, b)]
        counts = [np.array([[t.count(chr(65 + i)) for i in range(len(names))] for t in own], float).reshape(len(own), -1) for own in texts]
        n = [np.array([len(t) for t in own], float) for own in texts]
        longest = np.maximum(n[0][:, None], n[1][None, :])
        more = sum(np.maximum(0, counts[0][:, i][:, None] - counts[1][:, i][None, :]) for i in range(len(names))) if names else 0
        less = sum(np.maximum(0, counts[1][:, i][None, :] - counts[0][:, i][:, None]) for i in range(len(names))) if names else 0
        apart = np.maximum(more, less)  # edits at least
        held = [c > 0 for c in counts]
        common = held[0].astype(float) @ held[1].T.astype(float)
        union = held[0].sum(1)[:, None] + held[1].sum(1)[None, :] - common
        rest = 0.2 * (1 - np.abs(a["depth"].to_numpy()[:, None] - b["depth"].to_numpy()[None, :]) / 6) + 0.25 * (1 - np.abs(a["complexity"].to_numpy()[:, None] - b["complexity"].to_numpy()[None, :]))
        rest = rest + 0.25 * np.where(union > 0, common / np.maximum(union, 1), 1.0)
        bound = rest + 0.3 * (1 - apart / np.maximum(longest, 1))
        i, j = np.nonzero((bound >= threshold - 1e-9) & (a["rep"].to_numpy()[:, None] < b["rep"].to_numpy()[None, :]))
        out, ra, rb = [], a["rep"].to_numpy(), b["rep"].to_numpy()
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            d = edit_distance(texts[0][x], texts[1][y]) / longest[x, y] if longest[x, y] else 0.0
            s = rest[x, y] + 0.3 * (1 - d)
            if s >= threshold - 1e-12:
                out.append((int(ra[x]), int(rb[y]), float(s), 0))
        if not out:
            return none
        got = pd.DataFrame(out, columns=["a", "b", "similarity", "tried"])
        got.loc[0, "tried"] = len(i)
        return got

    return both.groupBy(*cell, "x", "y").applyInPandas(compare, PAIRS), c.drop("bucket")
