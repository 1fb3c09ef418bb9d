"""Further queries: projections, headings, corrections, reviews, exports."""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import state as S
from . import fixtures as X
from .registry import query


@query("prj3_chunks_with_quality", "SELECT id, importance::FLOAT AS importance, round(polarity * 100)::INT AS polarity_pct, TIMESTAMP '2024-01-01' + id * INTERVAL 1 HOUR AS extracted_at FROM chunks", "chunks")
def prj3(t):
    return X.chunks(t).select("id", F.col("importance").cast("float").alias("importance"), F.round(F.col("polarity") * 100).cast("int").alias("polarity_pct"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("extracted_at"))


@query("a16_match_counters", "SELECT CASE id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'approximate' END AS method, count(*) AS n, round(avg((id % 10) / 10.0), 6)::DOUBLE AS confidence, sum((end_offset - start_offset))::BIGINT AS chars FROM doc_chunks GROUP BY 1", "doc_chunks")
def a16(t):
    m = F.col("id") % 3
    c = X.doc_chunks(t).withColumn("method", F.when(m == 0, "exact").when(m == 1, "fuzzy").otherwise("approximate"))
    return c.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg(F.col("id") % 10 / 10.0), 6).alias("confidence"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("chars"))


def heading_paths(headings, key, pos, level, text, depth):
    """The path of each heading: of every shallower level the last heading, if no still shallower one came after it. Windows, no loop over rows."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for j in range(1, depth):
        at = F.last(F.when(F.col(level) == j, F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))), ignorenulls=True).over(w)
        cut = F.last(F.when(F.col(level) < j, F.col(pos)), ignorenulls=True).over(w)
        parts.append(F.when((F.col(level) > j) & (F.coalesce(cut, F.lit(-1)) < at["p"]), at["t"]))
    return headings.withColumn("path", F.concat_ws("/", *parts, F.col(text)))


_W10 = "OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"


@query("w10_heading_paths", f"""WITH h AS (SELECT conv_id, turn, (turn * 2 + conv_id) % 3 + 1 AS level, role || turn AS t FROM conversations),
  p AS (SELECT *, last_value(CASE WHEN level = 1 THEN turn END IGNORE NULLS) {_W10} AS p1, last_value(CASE WHEN level = 1 THEN t END IGNORE NULLS) {_W10} AS t1, last_value(CASE WHEN level = 2 THEN turn END IGNORE NULLS) {_W10} AS p2, last_value(CASE WHEN level = 2 THEN t END IGNORE NULLS) {_W10} AS t2 FROM h)
  SELECT conv_id, turn, concat_ws('/', CASE WHEN level > 1 THEN t1 END, CASE WHEN level > 2 AND coalesce(p1, -1) < p2 THEN t2 END, t) AS path FROM p""")
def w10(t):
    h = t.conversations.select("conv_id", "turn", ((F.col("turn") * 2 + F.col("conv_id")) % 3 + 1).alias("level"), F.concat("role", "turn").alias("t"))
    return heading_paths(h, "conv_id", "turn", "level", "t", 3).select("conv_id", "turn", "path")


def _mapped(name, schema, f):
    import pandas as pd

    def run(t):
        d = t.documents.where("text is not null").select("doc_id", "text")

        def part(batches):
            for b in batches:
                yield pd.DataFrame([f(d_, x) for d_, x in zip(b["doc_id"], b["text"], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

        return d.mapInPandas(part, schema)

    query(name)(run)


def _place(doc, text, room):
    """A place anywhere in the text, by the document's id."""
    return zlib.crc32(str(doc).encode()) % max(1, len(text) - room)


def _annotation(doc, text):
    """A marked passage in a text that has changed since: not at all, in the passage, and what is known of its surroundings less and less."""
    kind, at = (doc or 0) % 5, _place(doc, text, 60)
    needle, before, after = text[at:at + 60], text[max(0, at - 30):at], text[at + 60:at + 90]
    new = text if kind == 0 else text[:at] + needle[:20] + "X" + needle[21:] + text[at + 60:]
    if kind == 4:
        needle = "".join(chr(0x4E00 + ord(c) % 97) for c in needle)
    near = new[max(0, at - 200):at + 260] if kind == 2 else None
    h = M.match_annotation(needle, new, *((before, after) if kind in (1, 4) else ("", "")), near, max(0, at - 200))
    return doc, h.start if h else None, h.end if h else None, h.confidence if h else None, h.method if h else "lost"


def _repair(doc, text):
    """A stored chunk: as it is, with squeezed white space, rewritten in its middle, or rewritten throughout."""
    kind, at = (doc or 0) % 4, _place(doc, text, 400)
    chunk = text[at:at + 400]
    if kind:
        chunk = " ".join(chunk.split())
    if kind == 2:
        chunk = f"{chunk[:120]} other words {chunk[160:]}"
    if kind == 3:
        chunk = chunk[::-1]
    h = M.repair_offset(chunk, text, at)
    return doc, h.start if h else None, h.end if h else None, h.method if h else "lost"


_mapped("str4_annotation_match", "doc_id long, start int, end int, confidence double, method string", _annotation)
_mapped("str30_offset_repair", "doc_id long, start int, end int, method string", _repair)


@query("str6_offset_correction")
def str6(t):
    d = t.documents
    c = X.doc_chunks(t).select("document_id", "chunk_index", F.concat(F.lit("# "), F.trim("content")).alias("content"))
    return M.match_documents(c, d.select(F.col("doc_id").alias("document_id"), "text"), M.correct_offsets)


@query("d6_offset_corrections", """WITH n AS (SELECT id, document_id, chunk_index, start_offset, end_offset, lag(end_offset) OVER w AS p, lead(start_offset) OVER w AS n, CASE WHEN id % 5 = 0 THEN start_offset + 10 WHEN id % 5 = 1 THEN start_offset - 10 END AS s, end_offset AS e FROM doc_chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
  o AS (SELECT *, s IS NOT NULL AND e > s AND coalesce(s >= p, true) AND coalesce(e <= n, true) AS ok FROM n)
  SELECT id, CASE WHEN ok THEN s ELSE start_offset END AS start_offset, CASE WHEN s IS NULL THEN 'unchanged' WHEN ok THEN 'corrected' ELSE 'rejected' END AS status, CASE WHEN ok THEN 1 ELSE 0 END AS history FROM o""", "doc_chunks")
def d6(t):
    c = X.doc_chunks(t).select("id", "document_id", "chunk_index", "start_offset", "end_offset")
    shift = F.when(F.col("id") % 5 == 0, 10).when(F.col("id") % 5 == 1, -10)
    fix = c.where("id % 5 < 2").select("id", (F.col("start_offset") + shift).alias("new_start"), F.col("end_offset").alias("new_end"))
    r = S.correct_chunks(c.withColumn("history", F.array().cast("array<struct<start_offset:int,end_offset:int>>")), fix)
    return r.select("id", "start_offset", "status", F.size("history").alias("history"))


@query("d11_updated_at", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-30' ELSE o_orderdate END AS updated_at FROM orders")
def d11(t):
    """Orders against themselves with another priority on finished ones: changed rows are stamped."""
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    new = old.drop("updated_at").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")))
    return S.touched(old, new, "o_orderkey", F.lit("2024-01-30").cast("timestamp")).select("o_orderkey", "updated_at")


@query("d15_recovery_review", """WITH d AS (SELECT user_id * 7 AS id, arg_max(event_type <> 'error', event_id) AS accept FROM events WHERE event_type IN ('error', 'view') GROUP BY 1)
  SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND d.accept IS NULL AS needs_review FROM orders LEFT JOIN d ON d.id = o_orderkey WHERE coalesce(accept, true)""")
def d15(t):
    d = t.events.where("event_type in ('error', 'view')").select((F.col("user_id") * 7).alias("id"), (F.col("event_type") != "error").alias("accept"), F.col("event_id").alias("seq"))
    return S.review(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("needs_review")), d)


@query("snk4_export_manifest", "SELECT document_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, md5(string_agg(content, '' ORDER BY chunk_index)) AS digest FROM doc_chunks GROUP BY document_id", "doc_chunks")
def snk4(t):
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return X.doc_chunks(t).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.md5(F.array_join(F.transform(rows, lambda x: x["content"]), "").cast("binary")).alias("digest"))


@query("snk6_annotation_export", """SELECT p.document_id, count(*) AS annotations, string_agg(p.entity_id || ':' || v.value, ',' ORDER BY p.entity_id) AS rows FROM components p JOIN components v ON v.entity_id = p.entity_id AND v.component_type = 'Visual' WHERE p.component_type = 'Position' GROUP BY p.document_id""", "components")
def snk6(t):
    from .q_documents import annotations

    rows = F.array_sort(F.collect_list(F.struct("entity_id", "color")))
    return annotations(X.components(t)).groupBy("document_id").agg(F.count("*").alias("annotations"), F.array_join(F.transform(rows, lambda x: F.concat(x["entity_id"].cast("string"), F.lit(":"), x["color"])), ",").alias("rows"))
