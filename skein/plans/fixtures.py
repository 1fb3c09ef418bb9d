"""Adapters from the driver's tables to the shapes the operators work on, in Spark and in SQL (FIXTURES.md, part C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import rank_within
from .registry import PARTS, Tables

PARTS["chunks"] = ((), """SELECT vec_id AS id, label AS document_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS chunk_index,
  vec_id % 10 <> 0 AS is_current, ((vec_id * 37) % 101) / 100.0 AS importance, (((vec_id * 53) % 201) - 100) / 100.0 AS polarity,
  ['c' || (vec_id % 4), 'd' || (vec_id % 3)] AS concepts, 'dom' || (label % 4) AS domain, embedding::DOUBLE[] AS embedding FROM embeddings""")


def chunks(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.embeddings.select(
        v.alias("id"), F.col("label").alias("document_id"),
        (v % 10 != 0).alias("is_current"), ((v * 37) % 101 / 100.0).alias("importance"), (((v * 53) % 201 - 100) / 100.0).alias("polarity"),
        F.array(F.concat(F.lit("c"), v % 4), F.concat(F.lit("d"), v % 3)).alias("concepts"), F.concat(F.lit("dom"), F.col("label") % 4).alias("domain"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def chunk_numbers(t: Tables) -> DataFrame:
    """id, document_id, chunk_index: ranks from one range-partitioned sort, as a label may hold a third of all rows."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"))
    return rank_within(rows, "document_id", [F.col("id")]).select("id", "document_id", (F.col("rank") - 1).cast("int").alias("chunk_index"))


PARTS["edges"] = ((), """SELECT vec_id AS source, (vec_id * 31 + j * 17) % 97 AS target,
  ['semantic_similarity', 'contradiction_detection', 'thematic_bridge'][((vec_id + j) % 3 + 1)::INT] AS connection_type,
  ((vec_id * 13 + j * 29) % 101) / 100.0 AS strength,
  CASE (vec_id + (vec_id * 31 + j * 17) % 97) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS user_validated, (vec_id + j) % 5 = 0 AS user_starred
  FROM embeddings, (SELECT unnest(range(1, 5)) AS j) WHERE vec_id <> (vec_id * 31 + j * 17) % 97""")


def edges(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("source"), F.explode(F.array(*[F.lit(j).cast("long") for j in range(1, 5)])).alias("j"))
    e = e.withColumn("target", (F.col("source") * 31 + F.col("j") * 17) % 97).where("source <> target")
    kind = F.element_at(F.array(*map(F.lit, ("semantic_similarity", "contradiction_detection", "thematic_bridge"))), ((F.col("source") + F.col("j")) % 3 + 1).cast("int"))
    s = (F.col("source") + F.col("target")) % 3
    return e.select("source", "target", kind.alias("connection_type"), ((F.col("source") * 13 + F.col("j") * 29) % 101 / 100.0).alias("strength"),
                    F.when(s == 0, True).when(s == 1, False).alias("user_validated"), ((F.col("source") + F.col("j")) % 5 == 0).alias("user_starred"))


PARTS["doc_rows"] = ((), """SELECT doc_id AS id, doc_id % 7 AS user_id, 'doc ' || doc_id AS title, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS created_at,
  lang, source, n_chars FROM documents""")


def doc_rows(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(1704067200) + d * 3600)
    return t.documents.select(d.alias("id"), (d % 7).alias("user_id"), F.concat(F.lit("doc "), d).alias("title"), created.alias("created_at"), "lang", "source", "n_chars")


PARTS["doc_chunks"] = ((), """SELECT doc_id * 1000 + i AS id, doc_id AS document_id, i::INT AS chunk_index, (i * 500)::INT AS start_offset,
  least(i * 500 + 500, length(text))::INT AS end_offset, substr(text, (i * 500 + 1)::INT, 500) AS content, (doc_id + i) % 6 <> 0 AS is_current
  FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 499) // 500)) AS i)""")


def doc_chunks(t: Tables) -> DataFrame:
    n = F.floor((F.length("text") + 499) / 500)
    d = t.documents.select("doc_id", "text", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("i"))
    return d.select((F.col("doc_id") * 1000 + F.col("i")).alias("id"), F.col("doc_id").alias("document_id"), F.col("i").cast("int").alias("chunk_index"), (F.col("i") * 500).cast("int").alias("start_offset"),
                    F.least(F.col("i") * 500 + 500, F.length("text")).cast("int").alias("end_offset"), F.expr("substring(text, int(i * 500 + 1), 500)").alias("content"), ((F.col("doc_id") + F.col("i")) % 6 != 0).alias("is_current"))


PARTS["anchors"] = ((), """SELECT doc_id AS document_id, i::INT AS anchor_index, (i * 700 + doc_id % 100)::INT AS start_offset, least(i * 700 + doc_id % 100 + 700, length(text))::INT AS end_offset,
  'h' || (i % 3) AS heading, (i + 1)::INT AS page_start, (i + 2)::INT AS page_end, 's' || (i % 5) AS section_marker
  FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 699) // 700)) AS i) WHERE i % 4 <> 0 AND i * 700 + doc_id % 100 < length(text)""")


def anchors(t: Tables) -> DataFrame:
    n = F.floor((F.length("text") + 699) / 700)
    d = t.documents.select("doc_id", F.length("text").alias("n"), F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("i")).where("i % 4 <> 0")
    start = F.col("i") * 700 + F.col("doc_id") % 100
    return d.where(start < F.col("n")).select(F.col("doc_id").alias("document_id"), F.col("i").cast("int").alias("anchor_index"), start.cast("int").alias("start_offset"), F.least(start + 700, "n").cast("int").alias("end_offset"),
                    F.concat(F.lit("h"), F.col("i") % 3).alias("heading"), (F.col("i") + 1).cast("int").alias("page_start"), (F.col("i") + 2).cast("int").alias("page_end"), F.concat(F.lit("s"), F.col("i") % 5).alias("section_marker"))


PARTS["components"] = ((), """SELECT o_orderkey AS entity_id, 'Position' AS component_type, o_custkey AS document_id, (o_orderkey % 1000)::INT AS start_offset, (o_orderkey % 1000 + 50)::INT AS end_offset, NULL::VARCHAR AS value, o_orderdate AS created_at FROM orders
  UNION ALL SELECT o_orderkey, 'Visual', o_custkey, NULL, NULL, o_orderpriority, o_orderdate FROM orders
  UNION ALL SELECT o_orderkey, 'Content', o_custkey, NULL, NULL, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 5 <> 0""")


def components(t: Tables) -> DataFrame:
    o, none = t.orders, F.lit(None)
    key = [F.col("o_orderkey").alias("entity_id")]
    start = (F.col("o_orderkey") % 1000).cast("int")

    def rows(df, kind, s, e, v):
        return df.select(*key, F.lit(kind).alias("component_type"), F.col("o_custkey").alias("document_id"), s.cast("int").alias("start_offset"), e.cast("int").alias("end_offset"), v.cast("string").alias("value"), F.col("o_orderdate").alias("created_at"))

    return rows(o, "Position", start, start + 50, none).unionByName(rows(o, "Visual", none, none, F.col("o_orderpriority"))).unionByName(rows(o.where("o_orderkey % 5 <> 0"), "Content", none, none, F.col("o_orderstatus")))


PARTS["cards"] = ((), """SELECT l_orderkey * 10 + l_linenumber AS card_id, l_orderkey AS document_id, p_brand AS deck_id, l_shipdate AS next_review, l_shipdate - INTERVAL 30 DAY AS last_review,
  l_discount * 100 AS difficulty, l_quantity AS stability, (l_linenumber - 1)::INT AS lapses, (l_linenumber * 2)::INT AS reps,
  CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'N' THEN 'draft' ELSE 'suspended' END AS status, [p_type, l_linestatus] AS tags, [l_partkey, l_suppkey] AS chunk_ids
  FROM lineitem JOIN part ON l_partkey = p_partkey""")


def cards(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"), F.col("l_orderkey").alias("document_id"), F.col("p_brand").alias("deck_id"), F.col("l_shipdate").alias("next_review"), (F.col("l_shipdate") - F.expr("interval 30 days")).alias("last_review"),
                    (F.col("l_discount") * 100).alias("difficulty"), F.col("l_quantity").alias("stability"), (F.col("l_linenumber") - 1).cast("int").alias("lapses"), (F.col("l_linenumber") * 2).cast("int").alias("reps"),
                    F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "N", "draft").otherwise("suspended").alias("status"), F.array("p_type", "l_linestatus").alias("tags"), F.array("l_partkey", "l_suppkey").alias("chunk_ids"))


_RATING = "CASE event_type WHEN 'error' THEN 'again' WHEN 'click' THEN 'hard' WHEN 'view' THEN 'good' WHEN 'purchase' THEN 'easy' END"
PARTS["reviews"] = ((), f"SELECT event_id, user_id, ts, ts::DATE AS day, {_RATING} AS rating, floor(value * 100)::BIGINT AS time_ms FROM events WHERE event_type <> 'signup'")


def reviews(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'signup'").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.expr(_RATING).alias("rating"), F.floor(F.col("value") * 100).cast("long").alias("time_ms"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
PARTS["job_events"] = ((), f"""SELECT user_id * 100000 + event_id // 5 AS job_id, user_id, event_id, ts, {_STATUS} AS status,
  (event_id % 4)::INT AS retry_count, CASE event_id % 3 WHEN 0 THEN 'network timeout' WHEN 1 THEN 'disk full' ELSE 'temporary outage' END AS last_error FROM events""")


def job_events(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select((F.col("user_id") * 100000 + F.floor(e / 5)).alias("job_id"), "user_id", "event_id", "ts", F.expr(_STATUS).alias("status"), (e % 4).cast("int").alias("retry_count"),
                           F.when(e % 3 == 0, "network timeout").when(e % 3 == 1, "disk full").otherwise("temporary outage").alias("last_error"))


PARTS["jobs"] = (("job_events",), """SELECT job_id, user_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at, max(retry_count)::INT AS retry_count,
  arg_max(last_error, (ts, event_id)) AS last_error FROM job_events GROUP BY job_id, user_id""")


def jobs(t: Tables) -> DataFrame:
    at = F.struct("ts", "event_id")
    return job_events(t).groupBy("job_id", "user_id").agg(F.max_by("status", at).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max("retry_count").alias("retry_count"), F.max_by("last_error", at).alias("last_error"))


PARTS["segments"] = ((), "SELECT conv_id, turn, role, text, length(text)::INT AS n, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS start_char FROM conversations")


def segments(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    return t.conversations.select("conv_id", "turn", "role", "text", n.alias("n"), (F.sum(n + 1).over(w) - n - 1).alias("start_char"))
