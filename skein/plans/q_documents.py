"""Queries over chunks of documents, components, intervals and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import state as S
from ..operators.windows import running_offset
from . import fixtures as X
from .registry import query


@query("prj1_chunks_for_engines", "SELECT id, document_id, polarity, concepts[1] AS primary_concept, domain AS primary_domain, len(concepts) AS concept_count FROM chunks WHERE is_current", "chunks")
def prj1(t):
    return X.chunks(t).where("is_current").select("id", "document_id", "polarity", F.try_element_at("concepts", F.lit(1)).alias("primary_concept"), F.col("domain").alias("primary_domain"), F.size(F.coalesce("concepts", F.array().cast("array<string>"))).alias("concept_count"))


@query("prj1_events_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, coalesce(json_extract(props, '$.k')::BIGINT > 50, false) AS large FROM events")
def prj1j(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("large"))


@query("prj2_quality_flag", "SELECT doc_id, quality, coalesce(quality > 0, false) AS has_quality, coalesce(toxic > 0, false) AS is_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def prj2(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", F.coalesce(F.col("quality") > 0, F.lit(False)).alias("has_quality"), F.coalesce(F.col("toxic") > 0, F.lit(False)).alias("is_toxic"))


_PRESENT = "(lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (text IS NOT NULL)::INT"


@query("prj4_metadata_completeness", f"SELECT doc_id, round(({_PRESENT}) / 6.0, 6)::DOUBLE AS completeness FROM documents LEFT JOIN labels USING (doc_id)")
def prj4(t):
    parts = [F.col(c).isNotNull().cast("int") for c in ("lang", "source", "n_chars", "quality", "toxic", "text")]
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.round(sum(parts[1:], parts[0]) / 6.0, 6).alias("completeness"))


@query("flt1_chunks_by_emotion", "SELECT id, polarity FROM chunks WHERE domain = 'dom1' AND polarity BETWEEN -0.5 AND 0.5 AND importance >= 0.3", "chunks")
def flt1(t):
    return X.chunks(t).where((F.col("domain") == "dom1") & F.col("polarity").between(-0.5, 0.5) & (F.col("importance") >= 0.3)).select("id", "polarity")


@query("flt2_chunks_by_domain", "SELECT id, importance FROM chunks WHERE domain = 'dom2' AND importance >= 0.5", "chunks")
def flt2(t):
    return X.chunks(t).where("domain = 'dom2' and importance >= 0.5").select("id", "importance")


def optional_filter(df, **given):
    """Keep rows that equal (or reach, for names that end in _min) what is given; None says nothing."""
    for name, value in given.items():
        if value is not None:
            df = df.where(F.col(name[:-4]) >= value) if name.endswith("_min") else df.where(F.col(name) == value)
    return df


@query("flt3_optional_parameters", "SELECT id, domain FROM chunks WHERE importance >= 0.4 AND is_current", "chunks")
def flt3(t):
    return optional_filter(X.chunks(t), domain=None, importance_min=0.4, is_current=True).select("id", "domain")


@query("flt5_has_timestamps", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT >= 10, false) AS has_it FROM events WHERE event_type = 'view'")
def flt5(t):
    return t.events.where("event_type = 'view'").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long") >= 10, F.lit(False)).alias("has_it"))


@query("flt9_annotations_in_document", """SELECT p.entity_id, v.value AS color, c.value AS note FROM components p JOIN components v ON v.entity_id = p.entity_id AND v.component_type = 'Visual'
  LEFT JOIN components c ON c.entity_id = p.entity_id AND c.component_type = 'Content' WHERE p.component_type = 'Position' AND p.document_id % 50 = 7 AND (v.value ILIKE '%high%' OR c.value ILIKE '%f%')""", "components")
def flt9(t):
    a = annotations(X.components(t).where("document_id % 50 = 7"))
    return a.where(F.lower("color").contains("high") | F.lower("note").contains("f")).select("entity_id", "color", "note")


def annotations(components):
    """Position, Visual and Content rows of an entity in one row: a pivot in one aggregation instead of self joins. Needs Position and Visual."""
    def at(kind, c):
        return F.max(F.when(F.col("component_type") == kind, F.col(c)))

    g = components.groupBy("entity_id").agg(at("Position", "document_id").alias("document_id"), at("Position", "start_offset").alias("start_offset"), at("Position", "end_offset").alias("end_offset"), at("Visual", "value").alias("color"), at("Content", "value").alias("note"), F.max("created_at").alias("created_at"))
    return g.where("start_offset is not null and color is not null")


@query("j8_annotations_in_range", """SELECT DISTINCT p.entity_id, p.document_id, p.start_offset, p.end_offset, v.value AS color, c.value AS note FROM components p JOIN components v ON v.entity_id = p.entity_id AND v.component_type = 'Visual'
  LEFT JOIN components c ON c.entity_id = p.entity_id AND c.component_type = 'Content' WHERE p.component_type = 'Position' AND p.start_offset < 300 AND p.end_offset > 200""", "components")
def j8(t):
    return annotations(X.components(t)).where("start_offset < 300 and end_offset > 200").select("entity_id", "document_id", "start_offset", "end_offset", "color", "note")


@query("j27_ecs_query", """WITH k AS (SELECT entity_id FROM components WHERE component_type IN ('Position', 'Content') AND document_id % 10 = 3 GROUP BY entity_id HAVING count(DISTINCT component_type) = 2)
  SELECT entity_id, count(*) AS components, string_agg(component_type, ',' ORDER BY component_type) AS types FROM components WHERE entity_id IN (SELECT entity_id FROM k) GROUP BY entity_id""", "components")
def j27(t):
    c = X.components(t)
    ids = c.where("component_type in ('Position', 'Content') and document_id % 10 = 3").groupBy("entity_id").agg(F.count_distinct("component_type").alias("n")).where("n = 2").select("entity_id")
    return c.join(ids, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("components"), F.array_join(F.array_sort(F.collect_list("component_type")), ",").alias("types"))


@query("j21_entity_type_backfill", """SELECT o_orderkey AS entity_id, CASE WHEN EXISTS (SELECT 1 FROM components c WHERE c.entity_id = o_orderkey AND c.component_type = 'Content') THEN 'annotation'
  WHEN o_orderkey % 2 = 0 THEN 'spark' END AS entity_type FROM orders""", "components")
def j21(t):
    has = X.components(t).where("component_type = 'Content'").select(F.col("entity_id").alias("o_orderkey")).distinct().withColumn("h", F.lit(True))
    return t.orders.select("o_orderkey").join(has, "o_orderkey", "left").select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("h"), "annotation").when(F.col("o_orderkey") % 2 == 0, "spark").alias("entity_type"))


@query("flt10_recent_notes", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderpriority LIKE '%URGENT%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 10")
def flt10(t):
    return t.orders.where(F.col("o_orderpriority").contains("URGENT")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "id").offset(10).limit(20)


@query("flt12_unvalidated_buckets", """WITH c AS (SELECT id, document_id, id % 7 = 0 AS interpolated, CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM doc_chunks WHERE is_current),
  b AS (SELECT *, 'interpolated' AS bucket FROM c WHERE interpolated UNION ALL SELECT *, confidence FROM c WHERE confidence IN ('low', 'medium'))
  SELECT document_id, bucket, count(*) AS n FROM b GROUP BY document_id, bucket""", "doc_chunks")
def flt12(t):
    c = _confidence(X.doc_chunks(t).where("is_current"))
    b = F.filter(F.array(F.when(F.col("interpolated"), F.lit("interpolated")), F.when(F.col("confidence").isin("low", "medium"), F.col("confidence"))), lambda x: x.isNotNull())
    return c.select("document_id", F.explode(b).alias("bucket")).groupBy("document_id", "bucket").agg(F.count("*").alias("n"))


def _confidence(c):
    m = F.col("id") % 3
    return c.withColumn("interpolated", F.col("id") % 7 == 0).withColumn("confidence", F.when(m == 0, "low").when(m == 1, "medium").otherwise("high"))


@query("a10_confidence_histogram", """SELECT document_id, count(*) FILTER (id % 3 = 2) AS high, count(*) FILTER (id % 3 = 1) AS medium, count(*) FILTER (id % 3 = 0) AS low, count(*) FILTER (id % 7 = 0) AS interpolated FROM doc_chunks GROUP BY document_id""", "doc_chunks")
def a10(t):
    c = _confidence(X.doc_chunks(t))
    return c.groupBy("document_id").agg(*[F.count_if(F.col("confidence") == x).alias(x) for x in ("high", "medium", "low")], F.count_if("interpolated").alias("interpolated"))


@query("flt13_synthetic_chunks", "SELECT id, document_id FROM doc_chunks WHERE is_current AND id % 9 = 4", "doc_chunks")
def flt13(t):
    return X.doc_chunks(t).withColumn("position_confidence", F.when(F.col("id") % 9 == 4, "synthetic").otherwise("exact")).where("is_current and position_confidence = 'synthetic'").select("id", "document_id")


@query("j10_metadata_transfer", """WITH o AS (SELECT c.id, c.document_id, c.start_offset, c.end_offset, a.* EXCLUDE (document_id, start_offset, end_offset), a.start_offset AS r_start, a.end_offset AS r_end FROM doc_chunks c JOIN anchors a ON a.document_id = c.document_id AND a.start_offset < c.end_offset AND a.end_offset > c.start_offset),
  g AS (SELECT id, count(*) AS n_o, max((least(end_offset, r_end) - greatest(start_offset, r_start)) / (end_offset - start_offset)::DOUBLE) AS share, list_sort(list(DISTINCT heading)) AS headings, min(page_start) AS page_start, max(page_end) AS page_end, arg_min(section_marker, r_start) AS section_marker FROM o GROUP BY id)
  SELECT c.id, c.document_id, coalesce(n_o, 0) AS n_overlaps, round(share, 6) AS share, array_to_string(headings, ',') AS headings, page_start, page_end, section_marker,
    CASE WHEN n_o >= 3 OR share >= 0.7 THEN 'high' WHEN share >= 0.3 THEN 'medium' WHEN share IS NOT NULL THEN 'low' END AS confidence FROM doc_chunks c LEFT JOIN g ON g.id = c.id""", "doc_chunks anchors")
def j10(t):
    return I.transfer_metadata(X.doc_chunks(t), X.anchors(t)).withColumn("headings", F.when(F.col("headings").isNotNull(), F.array_join("headings", ","))).withColumnRenamed("overlaps", "n_overlaps")


@query("j11_nearest_anchor", """WITH b AS (SELECT c.id, arg_max(a.page_end, (a.end_offset, a.anchor_index)) AS before FROM doc_chunks c JOIN anchors a ON a.document_id = c.document_id AND a.end_offset <= c.start_offset GROUP BY c.id),
  f AS (SELECT c.id, arg_min(a.page_start, (a.start_offset, a.anchor_index)) AS after FROM doc_chunks c JOIN anchors a ON a.document_id = c.document_id AND a.start_offset >= c.end_offset GROUP BY c.id)
  SELECT c.document_id, c.id, coalesce(before, after) AS page, CASE WHEN before IS NOT NULL THEN 'before' WHEN after IS NOT NULL THEN 'after' END AS method FROM doc_chunks c LEFT JOIN b USING (id) LEFT JOIN f USING (id)""", "doc_chunks anchors")
def j11(t):
    return I.nearest_anchor(X.doc_chunks(t), X.anchors(t))


PART_SEL = "SELECT doc_id AS selection_id, doc_id AS document_id, (doc_id * 37 % 900)::INT AS start_offset, (doc_id * 37 % 900 + 1 + doc_id * 53 % 3000)::INT AS end_offset FROM documents"


def selections(t):
    d = F.col("doc_id")
    return t.documents.select(d.alias("selection_id"), d.alias("document_id"), (d * 37 % 900).cast("int").alias("start_offset"), (d * 37 % 900 + 1 + d * 53 % 3000).cast("int").alias("end_offset"))


@query("j12_spanned_chunks", f"""WITH s AS ({PART_SEL}) SELECT selection_id, c.id AS chunk_id, row_number() OVER w::INT AS position, row_number() OVER w = 1 AS is_primary FROM s JOIN doc_chunks c ON c.document_id = s.document_id AND c.start_offset <= s.end_offset AND c.end_offset >= s.start_offset
  QUALIFY row_number() OVER w <= 5 WINDOW w AS (PARTITION BY selection_id ORDER BY chunk_index)""".replace("QUALIFY row_number() OVER w <= 5 WINDOW w AS (PARTITION BY selection_id ORDER BY chunk_index)", "WINDOW w AS (PARTITION BY selection_id ORDER BY chunk_index) QUALIFY row_number() OVER w <= 5"), "doc_chunks")
def j12(t):
    return I.spanned_chunks(selections(t), X.doc_chunks(t))


@query("j13_point_lookup", f"""WITH s AS ({PART_SEL}) SELECT selection_id AS point_id, s.document_id, c.id AS chunk_id FROM s LEFT JOIN doc_chunks c ON c.document_id = s.document_id AND c.start_offset <= s.end_offset AND s.end_offset < c.end_offset""", "doc_chunks")
def j13(t):
    return I.stab(selections(t).select(F.col("selection_id").alias("point_id"), "document_id", F.col("end_offset").alias("pos")), X.doc_chunks(t))


@query("j14_containing_chunk", f"""WITH s AS (SELECT selection_id, document_id, start_offset, start_offset + 40 AS end_offset FROM ({PART_SEL})) SELECT selection_id, min(c.id) AS chunk_id FROM s LEFT JOIN doc_chunks c ON c.document_id = s.document_id AND c.start_offset <= s.start_offset AND s.end_offset <= c.end_offset GROUP BY selection_id""", "doc_chunks")
def j14(t):
    s = selections(t).withColumn("end_offset", F.col("start_offset") + 40)
    c = X.doc_chunks(t).select("document_id", F.col("id").alias("chunk_id"), F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end"))
    hit = I.overlapping(s, c).where("r_start <= start_offset and end_offset <= r_end").groupBy("selection_id").agg(F.min("chunk_id").alias("chunk_id"))
    return s.select("selection_id").join(hit, "selection_id", "left")


@query("j29_neighbour_conflicts", "SELECT id, coalesce(lag(e) OVER w > s, false) AS hits_previous, coalesce(lead(s) OVER w < e, false) AS hits_next FROM (SELECT id, document_id, chunk_index, start_offset - (id % 3)::INT AS s, end_offset + (id % 2)::INT AS e FROM doc_chunks) WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)", "doc_chunks")
def j29(t):
    c = X.doc_chunks(t).withColumn("start_offset", F.col("start_offset") - (F.col("id") % 3).cast("int")).withColumn("end_offset", F.col("end_offset") + (F.col("id") % 2).cast("int"))
    return I.neighbour_conflicts(c).select("id", "hits_previous", "hits_next")


_OVER = "(SELECT id, document_id, chunk_index, start_offset - 100 * (id % 4)::INT AS start_offset, end_offset - 300 * (id % 3)::INT AS end_offset FROM doc_chunks)"


def _shifted(t):
    return X.doc_chunks(t).withColumn("start_offset", (F.col("start_offset") - 100 * (F.col("id") % 4)).cast("int")).withColumn("end_offset", (F.col("end_offset") - 300 * (F.col("id") % 3)).cast("int"))


@query("w3_overlap_dedup", f"""WITH m AS (SELECT *, max(end_offset) OVER (PARTITION BY document_id ORDER BY start_offset, end_offset DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {_OVER})
  SELECT id, document_id, (row_number() OVER (PARTITION BY document_id ORDER BY start_offset, end_offset DESC, id) - 1)::INT AS new_index FROM m WHERE m IS NULL OR NOT (start_offset < m AND end_offset <= m)""", "doc_chunks")
def w3(t):
    return I.drop_contained(_shifted(t)).select("id", "document_id", "new_index")


@query("w4_overlap_flags", f"SELECT id, coalesce(lag(end_offset) OVER (PARTITION BY document_id ORDER BY chunk_index) > start_offset, false) AS overlaps, end_offset > 3000 AS past_end FROM {_OVER}", "doc_chunks")
def w4(t):
    p = F.lag("end_offset").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return _shifted(t).select("id", F.coalesce(p > F.col("start_offset"), F.lit(False)).alias("overlaps"), (F.col("end_offset") > 3000).alias("past_end"))


@query("w5_gap_fill", """WITH c AS (SELECT * FROM doc_chunks WHERE id % 3 <> 1), n AS (SELECT *, lead(start_offset) OVER (PARTITION BY document_id ORDER BY start_offset, id) AS n FROM c)
  SELECT document_id, chunk_index::DOUBLE AS position, start_offset, end_offset, false AS synthetic FROM c UNION ALL SELECT document_id, chunk_index + 0.5::DOUBLE, end_offset, n, true FROM n WHERE n > end_offset""", "doc_chunks")
def w5(t):
    return I.fill_gaps(X.doc_chunks(t).where("id % 3 <> 1"))


@query("w6_interpolation", """WITH k AS (SELECT *, CASE WHEN id % 4 = 0 THEN chunk_index END AS i, CASE WHEN id % 4 = 0 THEN start_offset END AS v FROM doc_chunks),
  b AS (SELECT *, last_value(i IGNORE NULLS) OVER p AS i1, last_value(v IGNORE NULLS) OVER p AS v1, first_value(i IGNORE NULLS) OVER n AS i2, first_value(v IGNORE NULLS) OVER n AS v2 FROM k
    WINDOW p AS (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT id, round(CASE WHEN v1 IS NULL THEN v2 WHEN v2 IS NULL THEN v1 WHEN i2 = i1 THEN v1 ELSE v1 + (chunk_index - i1) / (i2 - i1)::DOUBLE * (v2 - v1) END, 4)::DOUBLE AS interpolated FROM b""", "doc_chunks")
def w6(t):
    return I.interpolate(X.doc_chunks(t).withColumn("k", F.col("id") % 4 == 0), "k", "start_offset").select("id", F.round(F.col("interpolated").cast("double"), 4).alias("interpolated"))


@query("w9_running_offset", "SELECT conv_id, turn, n, start_char::BIGINT AS start_char FROM segments", "segments")
def w9(t):
    return running_offset(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "n", "start_char")


@query("j15_chunk_video_timestamp", """WITH c AS (SELECT conv_id, unnest(range(0, 10)) * 150 AS pos FROM (SELECT DISTINCT conv_id FROM conversations))
  SELECT c.conv_id, c.pos, s.turn, s.role FROM c LEFT JOIN segments s ON s.conv_id = c.conv_id AND s.start_char <= c.pos AND c.pos < s.start_char + s.n + 1""", "segments")
def j15(t):
    s = X.segments(t)
    p = s.select("conv_id").distinct().withColumn("pos", F.explode(F.expr("sequence(0L, 1350L, 150L)")))
    m = p.join(s.select("conv_id", "turn", "role", "start_char", "n"), "conv_id").where("start_char <= pos and pos < start_char + n + 1").select("conv_id", "pos", "turn", "role")
    return p.join(m, ["conv_id", "pos"], "left")


@query("w11_block_position", "SELECT id, (row_number() OVER (PARTITION BY document_id, chunk_index // 4 ORDER BY chunk_index) - 1)::INT AS block FROM doc_chunks", "doc_chunks")
def w11(t):
    w = Window.partitionBy("document_id", F.floor(F.col("chunk_index") / 4)).orderBy("chunk_index")
    return X.doc_chunks(t).select("id", (F.row_number().over(w) - 1).alias("block"))


@query("w12_sliding_batches", "SELECT doc_id, s::BIGINT AS start_offset, substr(text, (s + 1)::INT, 3000) AS content FROM documents, LATERAL (SELECT unnest(range(0, greatest(length(text), 1), 2000)) AS s) WHERE text IS NOT NULL")
def w12(t):
    from ..operators.text import sliding_batches

    return sliding_batches(t.documents, size=3000, overlap=1000)


@query("a9_chunk_statistics", """SELECT document_id, count(*) AS chunks, round(avg(ceil(length(content) / 4.0)))::BIGINT AS avg_tokens, min(ceil(length(content) / 4.0))::BIGINT AS min_tokens, max(ceil(length(content) / 4.0))::BIGINT AS max_tokens,
  count(*) FILTER (ceil(length(content) / 4.0) > 120) AS oversized, count(*) FILTER (ceil(length(content) / 4.0) < 100) AS undersized, round(100.0 * count(*) FILTER (regexp_matches(content, '[.!?]\\s*$')) / count(*), 4)::DOUBLE AS sentence_end_pct FROM doc_chunks GROUP BY document_id""", "doc_chunks")
def a9(t):
    n = F.ceil(F.length("content") / 4)
    return X.doc_chunks(t).withColumn("n", n).groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(F.avg("n")).cast("long").alias("avg_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.count_if(F.col("n") > 120).alias("oversized"), F.count_if(F.col("n") < 100).alias("undersized"),
                                                                       F.round(100 * F.count_if(F.col("content").rlike(r"[.!?]\s*\z")) / F.count("*"), 4).alias("sentence_end_pct"))


@query("a15_match_statistics", "SELECT confidence, count(*) AS n, count(*) FILTER (interpolated) AS interpolated FROM (SELECT CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, id % 7 = 0 AS interpolated FROM doc_chunks) GROUP BY confidence", "doc_chunks")
def a15(t):
    return _confidence(X.doc_chunks(t)).groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("interpolated").alias("interpolated"))


@query("a18_recovery_rate", "SELECT document_id, coalesce(count(*) FILTER (id % 3 > 0) / nullif(count(*), 0)::DOUBLE, 1.0) AS rate FROM doc_chunks GROUP BY document_id", "doc_chunks")
def a18(t):
    return _confidence(X.doc_chunks(t)).groupBy("document_id").agg(F.coalesce(F.try_divide(F.count_if(F.col("confidence") != "low"), F.count("*")), F.lit(1.0)).alias("rate"))


@query("a19_recovery_confidence", "SELECT document_id, round(sum(CASE WHEN id % 3 > 0 THEN (id % 10) / 10.0 ELSE 0 END) / count(*), 6)::DOUBLE AS confidence FROM doc_chunks GROUP BY document_id", "doc_chunks")
def a19(t):
    c = F.when(F.col("id") % 3 > 0, F.col("id") % 10 / 10.0).otherwise(0.0)
    return X.doc_chunks(t).groupBy("document_id").agg(F.round(F.sum(c) / F.count("*"), 6).alias("confidence"))


@query("a20_import_conflicts", """WITH o AS (SELECT document_id, count(*) AS existing FROM doc_chunks WHERE is_current GROUP BY document_id), n AS (SELECT document_id, count(*) AS incoming FROM doc_chunks WHERE id % 2 = 0 GROUP BY document_id)
  SELECT document_id, coalesce(existing, 0) AS existing, coalesce(incoming, 0) AS incoming, CASE WHEN existing IS NULL THEN 'replace' WHEN incoming IS NULL THEN 'skip' WHEN existing = incoming THEN 'merge_smart' ELSE 'replace' END AS strategy FROM o FULL JOIN n USING (document_id)""", "doc_chunks")
def a20(t):
    c = X.doc_chunks(t)
    o = c.where("is_current").groupBy("document_id").agg(F.count("*").alias("o"))
    n = c.where("id % 2 = 0").groupBy("document_id").agg(F.count("*").alias("n"))
    s = F.when(F.col("o").isNull(), "replace").when(F.col("n").isNull(), "skip").when(F.col("o") == F.col("n"), "merge_smart").otherwise("replace")
    return o.join(n, "document_id", "full").select("document_id", F.coalesce("o", F.lit(0)).alias("existing"), F.coalesce("n", F.lit(0)).alias("incoming"), s.alias("strategy"))


@query("a21_overlap_coverage", """WITH n AS (SELECT c.id, c.document_id, count(a.document_id) AS o FROM doc_chunks c LEFT JOIN anchors a ON a.document_id = c.document_id AND a.start_offset < c.end_offset AND a.end_offset > c.start_offset GROUP BY c.id, c.document_id)
  SELECT document_id, round(100.0 * avg((o > 0)::INT), 4)::DOUBLE AS coverage, round(avg(o), 6)::DOUBLE AS mean_overlaps, 100.0 * avg((o > 0)::INT) < 70 AS warn FROM n GROUP BY document_id""", "doc_chunks anchors")
def a21(t):
    m = I.transfer_metadata(X.doc_chunks(t), X.anchors(t))
    cov = 100 * F.avg((F.col("overlaps") > 0).cast("int"))
    return m.groupBy("document_id").agg(F.round(cov, 4).alias("coverage"), F.round(F.avg("overlaps"), 6).alias("mean_overlaps"), (cov < 70).alias("warn"))


@query("a26_matching_report", "SELECT count(*) AS chunks, round(avg(len(string_split_regex(content, '[ \\t\\n\\r\\f\\x0B]+'))), 4)::DOUBLE AS avg_words, round(100.0 * count(*) FILTER (id % 3 = 2) / count(*), 4)::DOUBLE AS high_pct, round(100.0 * count(*) FILTER (is_current) / count(*), 4)::DOUBLE AS current_pct FROM doc_chunks", "doc_chunks")
def a26(t):
    c = _confidence(X.doc_chunks(t))
    pct = lambda x: F.round(100 * F.count_if(x) / F.count("*"), 4)
    return c.agg(F.count("*").alias("chunks"), F.round(F.avg(F.size(F.split("content", r"[ \t\n\r\f\x0B]+"))), 4).alias("avg_words"), pct(F.col("confidence") == "high").alias("high_pct"), pct(F.col("is_current")).alias("current_pct"))


@query("a27_offset_drift", """WITH d AS (SELECT c.document_id, c.start_offset - (instr(d.text, c.content) - 1) AS drift FROM doc_chunks c JOIN documents d ON d.doc_id = c.document_id)
  SELECT document_id, round(avg(drift), 4)::DOUBLE AS avg_drift, min(drift) AS min_drift, max(drift) AS max_drift, max(drift) - min(drift) < 10 AS consistent FROM d GROUP BY document_id""", "doc_chunks")
def a27(t):
    d = X.doc_chunks(t).join(t.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id").withColumn("drift", F.col("start_offset") - (F.expr("instr(text, content)") - 1))
    return d.groupBy("document_id").agg(F.round(F.avg("drift"), 4).alias("avg_drift"), F.min("drift").cast("long").alias("min_drift"), F.max("drift").cast("long").alias("max_drift"), (F.max("drift") - F.min("drift") < 10).alias("consistent"))


@query("a28_offset_verification", "SELECT document_id, count(*) FILTER (substr(text, start_offset + 1, end_offset - start_offset) = content) AS matches, count(*) FILTER (substr(text, start_offset + 1, end_offset - start_offset) <> content) AS mismatches FROM doc_chunks JOIN documents ON doc_id = document_id GROUP BY document_id", "doc_chunks")
def a28(t):
    d = X.doc_chunks(t).join(t.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    ok = F.expr("substring(text, start_offset + 1, end_offset - start_offset) = content")
    return d.groupBy("document_id").agg(F.count_if(ok).alias("matches"), F.count_if(~ok).alias("mismatches"))


@query("tg4_chunk_validation", """SELECT id, CASE WHEN length(trim(content)) < 50 THEN 'invalid' WHEN length(content) > 480 THEN 'oversized' ELSE 'valid' END AS status, least(1.0, greatest(0.0, (id % 150) / 100.0))::DOUBLE AS importance FROM doc_chunks""", "doc_chunks")
def tg4(t):
    n = F.length("content")
    return X.doc_chunks(t).select("id", F.when(F.length(F.trim("content")) < 50, "invalid").when(n > 480, "oversized").otherwise("valid").alias("status"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("id") % 150 / 100.0)).alias("importance"))


@query("tg7_json_explode", "SELECT conv_id, i::INT AS pos, x AS turn FROM (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id), LATERAL (SELECT unnest(turns) AS x, unnest(range(0, len(turns))) AS i)")
def tg7(t):
    g = t.conversations.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list("turn"))).alias("j"))
    return g.select("conv_id", F.posexplode(F.from_json("j", "array<bigint>")).alias("pos", "turn"))


@query("j22_duplicate_delete", "SELECT l_orderkey, l_suppkey % 4 AS slot, l_linenumber, l_shipdate FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey % 4 = a.l_suppkey % 4 AND b.l_shipdate < a.l_shipdate)")
def j22(t):
    r = F.rank().over(Window.partitionBy("l_orderkey", "slot").orderBy("l_shipdate"))
    return t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 4).alias("slot"), "l_linenumber", "l_shipdate").withColumn("r", r).where("r = 1").drop("r")


@query("src7_storage_sync", """WITH s AS (SELECT doc_id AS id, n_chars AS size FROM documents WHERE doc_id % 5 <> 0), d AS (SELECT doc_id AS id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 3 <> 0)
  SELECT coalesce(s.id, d.id) AS id, CASE WHEN d.id IS NULL THEN 'missing_from_db' WHEN s.id IS NULL THEN 'missing_from_storage' WHEN s.size = d.size THEN 'healthy' ELSE 'out_of_sync' END AS state FROM s FULL JOIN d ON s.id = d.id""")
def src7(t):
    from ..sources.storage import sync_state

    d = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return sync_state(d.where("id % 5 <> 0"), d.where("id % 3 <> 0").withColumn("size", F.col("size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)))


@query("set2_symmetric_difference", "SELECT doc_id, doc_id % 5 = 0 AS only_db FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 3 = 0)")
def set2(t):
    d = t.documents.select("doc_id")
    a, b = d.where("doc_id % 5 <> 0").withColumn("a", F.lit(1)), d.where("doc_id % 3 <> 0").withColumn("b", F.lit(1))
    return a.join(b, "doc_id", "full").where("a is null or b is null").select("doc_id", F.col("a").isNull().alias("only_db"))


@query("snk7_extraction_cache", "SELECT a.doc_id, b.doc_id IS NOT NULL AS hit FROM documents a LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 4 > 0) b ON a.doc_id = b.doc_id AND sha256(a.text) = sha256(CASE WHEN b.doc_id % 6 = 1 THEN b.text || 'x' ELSE b.text END)")
def snk7(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    cache = t.documents.where("doc_id % 4 > 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"), F.lit(True).alias("y"))
    return d.join(cache, ["doc_id", "h"], "left").select("doc_id", F.coalesce("y", F.lit(False)).alias("hit"))


@query("snk8_checkpoint_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def snk8(t):
    return t.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@query("snk2_batch_size", "SELECT n, least(greatest(least(ceil(n / 10.0), 100), 5), 65535 // 40)::BIGINT AS size FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def snk2(t):
    from ..sources.storage import batch_size

    return t.documents.groupBy("source").agg(F.count("*").alias("n")).select("n", batch_size(F.col("n"), 40).alias("size"))


@query("snk5_export_rollup", "SELECT document_id, count(*) AS chunks, string_agg(id::VARCHAR, ',' ORDER BY chunk_index) AS ids, sum(length(content))::BIGINT AS chars FROM doc_chunks GROUP BY document_id", "doc_chunks")
def snk5(t):
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "id")))
    return X.doc_chunks(t).groupBy("document_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(rows, lambda x: x["id"].cast("string")), ",").alias("ids"), F.sum(F.length("content")).alias("chars"))


@query("src10_source_loader", "SELECT document_id, string_agg(content, '' ORDER BY chunk_index) AS content FROM doc_chunks WHERE start_offset < 1200 AND end_offset > 300 GROUP BY document_id", "doc_chunks")
def src10(t):
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return X.doc_chunks(t).where("start_offset < 1200 and end_offset > 300").groupBy("document_id").agg(F.array_join(F.transform(rows, lambda x: x["content"]), "").alias("content"))


@query("j30_cache_freshness", """WITH s AS (SELECT doc_id AS id, doc_id * 7 % 100 AS updated FROM documents), c AS (SELECT doc_id AS id, doc_id * 11 % 100 AS cached FROM documents WHERE doc_id % 6 <> 0)
  SELECT s.id, CASE WHEN c.id IS NULL THEN 'missing' ELSE 'stale' END AS state FROM s LEFT JOIN c ON c.id = s.id WHERE c.id IS NULL OR updated > cached""")
def j30(t):
    s = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 100).alias("updated"))
    c = t.documents.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 11 % 100).alias("cached"))
    j = s.join(c, "id", "left").where("cached is null or updated > cached")
    return j.select("id", F.when(F.col("cached").isNull(), "missing").otherwise("stale").alias("state"))


@query("j31_book_lookup", "SELECT p_partkey, min(s_suppkey) AS s_suppkey FROM part JOIN supplier ON contains(lower(s_name), lpad((p_partkey % 100)::VARCHAR, 3, '0')) AND contains(lower(p_type), 'steel') GROUP BY p_partkey")
def j31(t):
    """Substring join: the suppliers (a bounded dimension, its size checked by Spark's broadcast limit) are cut into their runs of three digits first."""
    s = t.supplier.select("s_suppkey", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s_name") - 2), lambda i: F.substring(F.lower("s_name"), i, F.lit(3))))).alias("piece"))
    p = t.part.where(F.lower("p_type").contains("steel")).select("p_partkey", F.lpad((F.col("p_partkey") % 100).cast("string"), 3, "0").alias("piece"))
    return p.join(s, "piece").groupBy("p_partkey").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("d1_version_swap", """SELECT id, document_id, is_current, NULL::VARCHAR AS reprocessing_batch FROM doc_chunks WHERE document_id % 4 <> 0 UNION ALL SELECT id + 500, document_id, true, 'b1' FROM doc_chunks WHERE document_id % 4 = 0""", "doc_chunks")
def d1(t):
    c = X.doc_chunks(t).select("id", "document_id", "is_current").withColumn("reprocessing_batch", F.lit(None).cast("string"))
    new = c.where("document_id % 4 = 0").withColumn("id", F.col("id") + 500)
    return S.version_swap(c, new, new.select("document_id"), "b1")


def _import(strategy):
    def f(t):
        c = X.doc_chunks(t).select("document_id", "chunk_index", F.col("start_offset").alias("v"))
        old = c.where("document_id % 3 <> 0")
        new = c.where("document_id % 2 = 0 and chunk_index < 3").withColumn("v", F.col("v") + 7)
        return S.import_chunks(old, new, strategy, ["document_id", "chunk_index"], ["v"])

    return f


_IMP = "WITH c AS (SELECT document_id, chunk_index, start_offset AS v FROM doc_chunks), o AS (SELECT * FROM c WHERE document_id % 3 <> 0), n AS (SELECT document_id, chunk_index, v + 7 AS v FROM c WHERE document_id % 2 = 0 AND chunk_index < 3) "
query("d2_import_skip", _IMP + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE (document_id, chunk_index) NOT IN (SELECT document_id, chunk_index FROM o)", "doc_chunks")(_import("skip"))
query("d2_import_replace", _IMP + "SELECT * FROM o WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT * FROM n", "doc_chunks")(_import("replace"))
query("d2_import_merge", _IMP + "SELECT o.document_id, o.chunk_index, coalesce(n.v, o.v) AS v FROM o LEFT JOIN n USING (document_id, chunk_index)", "doc_chunks")(_import("merge_smart"))
