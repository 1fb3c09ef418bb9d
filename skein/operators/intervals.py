"""Joins of intervals on a text axis.

All joins are equi-joins on the document and a coarse bucket of the offset, with the exact predicate after: each interval is put in the buckets
that it touches, so a hot document is spread over its length and no nested loop is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _bucketed(df: DataFrame, start, end, size: int) -> DataFrame:
    return df.withColumn("_b", F.explode(F.sequence(F.floor(start / size), F.greatest(F.floor(start / size), F.floor(end / size)))))


def overlapping(left: DataFrame, right: DataFrame, key: str = "document_id", inclusive_end: bool = False, size: int = BUCKET) -> DataFrame:
    """Pairs of left (start_offset, end_offset) and right (r_start, r_end) of one key that overlap: each pair once.

    Half-open intervals; inclusive_end counts touching ends too.
    """
    a = _bucketed(left, F.col("start_offset"), F.col("end_offset"), size)
    b = _bucketed(right, F.col("r_start"), F.col("r_end"), size)
    j = a.join(b, [key, "_b"])
    hit = (F.col("r_start") <= F.col("end_offset")) & (F.col("r_end") >= F.col("start_offset")) if inclusive_end else (F.col("r_start") < F.col("end_offset")) & (F.col("r_end") > F.col("start_offset"))
    first = F.floor(F.greatest("start_offset", "r_start") / size) == F.col("_b")  # the bucket in which the overlap begins
    return j.where(hit & first).drop("_b")


def transfer_metadata(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per chunk (id, document_id, start_offset, end_offset): what the anchors that it overlaps say, and how sure that is.

    confidence: high from three overlaps or 70 % of the chunk's length, medium from 30 %, else low; null without any overlap.
    """
    a = anchors.select("document_id", F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end"), "heading", "page_start", "page_end", "section_marker")
    o = overlapping(chunks.select("id", "document_id", "start_offset", "end_offset"), a)
    part = F.least("end_offset", "r_end") - F.greatest("start_offset", "r_start")
    g = o.groupBy("id", "document_id", "start_offset", "end_offset").agg(F.count("*").alias("overlaps"), F.max(part / (F.col("end_offset") - F.col("start_offset"))).alias("share"), F.array_sort(F.collect_set("heading")).alias("headings"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by("section_marker", "r_start").alias("section_marker"))
    level = F.when((F.col("overlaps") >= 3) | (F.col("share") >= 0.7), "high").when(F.col("share") >= 0.3, "medium").otherwise("low")
    return chunks.select("id", "document_id").join(g.select("id", "overlaps", F.round("share", 6).alias("share"), "headings", "page_start", "page_end", "section_marker", level.alias("confidence")), "id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def nearest_anchor(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """As-of join both ways: the last anchor that ends at or before a chunk's start, else the first that starts at or after its end."""
    ev = chunks.select("document_id", F.col("start_offset").alias("pos"), F.lit(1).alias("kind"), "id", "end_offset", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("tie"))
    ends = anchors.select("document_id", F.col("end_offset").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("end_offset"), F.col("page_end").alias("page"), F.col("anchor_index").alias("tie"))
    w = Window.partitionBy("document_id").orderBy("pos", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    back = ev.unionByName(ends).withColumn("before", F.last("page", ignorenulls=True).over(w)).where("kind = 1").select("document_id", "id", "end_offset", "before")
    ev2 = back.select("document_id", F.col("end_offset").alias("pos"), F.lit(0).alias("kind"), "id", "before", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("tie"))
    starts = anchors.select("document_id", F.col("start_offset").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("before"), F.col("page_start").alias("page"), F.col("anchor_index").alias("tie"))
    w2 = Window.partitionBy("document_id").orderBy("pos", "kind", "tie").rowsBetween(0, Window.unboundedFollowing)
    return ev2.unionByName(starts).withColumn("after", F.first("page", ignorenulls=True).over(w2)).where("kind = 0").select("document_id", "id", F.coalesce("before", "after").alias("page"), F.when(F.col("before").isNotNull(), "before").when(F.col("after").isNotNull(), "after").alias("method"))


def spanned_chunks(selections: DataFrame, chunks: DataFrame, most: int = 5, inclusive_end: bool = True) -> DataFrame:
    """selections (selection_id, document_id, start_offset, end_offset): up to `most` chunks in order; the first is primary."""
    c = chunks.select("document_id", F.col("id").alias("chunk_id"), "chunk_index", F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end"))
    o = overlapping(selections, c, inclusive_end=inclusive_end)
    r = F.row_number().over(Window.partitionBy("selection_id").orderBy("chunk_index"))
    return o.withColumn("position", r).where(F.col("position") <= most).select("selection_id", "chunk_id", "position", (F.col("position") == 1).alias("is_primary"))


def stab(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """points (point_id, document_id, pos): the chunk whose half-open interval holds the point; as-of on the start, then the end is tested."""
    p = points.select("document_id", "pos", F.lit(1).alias("kind"), "point_id", F.lit(None).cast("struct<id:bigint,e:int>").alias("c"))
    c = chunks.select("document_id", F.col("start_offset").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point_id"), F.struct(F.col("id").alias("id"), F.col("end_offset").alias("e")).alias("c"))
    w = Window.partitionBy("document_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = p.unionByName(c).withColumn("last", F.last("c", ignorenulls=True).over(w)).where("kind = 1")
    return got.select("point_id", "document_id", F.when(F.col("pos") < F.col("last.e"), F.col("last.id")).alias("chunk_id"))


def drop_contained(df: DataFrame) -> DataFrame:
    """Chunks not wholly inside what precedes them (by start, then the longer first), renumbered."""
    w = Window.partitionBy("document_id").orderBy("start_offset", F.desc("end_offset"), "id")
    m = F.max("end_offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.withColumn("_m", m).where(F.col("_m").isNull() | ~((F.col("start_offset") < F.col("_m")) & (F.col("end_offset") <= F.col("_m"))))
    return kept.withColumn("new_index", F.row_number().over(w) - 1).drop("_m")


def fill_gaps(df: DataFrame) -> DataFrame:
    """The chunks and a synthetic one (index + 0.5) for each gap between neighbours."""
    w = Window.partitionBy("document_id").orderBy("start_offset", "id")
    n = df.withColumn("_n", F.lead("start_offset").over(w))
    gaps = n.where(F.col("_n") > F.col("end_offset")).select("document_id", (F.col("chunk_index") + 0.5).alias("position"), F.col("end_offset").alias("start_offset"), F.col("_n").alias("end_offset"), F.lit(True).alias("synthetic"))
    return df.select("document_id", F.col("chunk_index").cast("double").alias("position"), "start_offset", "end_offset", F.lit(False).alias("synthetic")).unionByName(gaps)


def interpolate(df: DataFrame, known: str, value: str) -> DataFrame:
    """`interpolated`: value where known, else on the line between the nearest known rows before and after (by chunk_index), else the nearer one's."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    at = F.when(F.col(known), F.struct("chunk_index", F.col(value).alias("v")))
    p = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumn("_p", p).withColumn("_n", n)
    t = F.try_divide(F.col("chunk_index") - F.col("_p.chunk_index"), F.col("_n.chunk_index") - F.col("_p.chunk_index"))
    line = F.col("_p.v") + F.coalesce(t, F.lit(0.0)) * (F.col("_n.v") - F.col("_p.v"))
    return d.withColumn("interpolated", F.coalesce(line, "_p.v", "_n.v")).drop("_p", "_n")


def neighbour_conflicts(df: DataFrame) -> DataFrame:
    """Rows whose interval runs into the one before or after by index."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return df.withColumn("hits_previous", F.coalesce(F.lag("end_offset").over(w) > F.col("start_offset"), F.lit(False))).withColumn("hits_next", F.coalesce(F.lead("start_offset").over(w) < F.col("end_offset"), F.lit(False)))
