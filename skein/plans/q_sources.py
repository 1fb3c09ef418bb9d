"""Queries for readers and writers by round trips, highlights in HTML, the cache, timers and checkpoints of jobs, and what the matcher found."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import caching, fallback, highlights, matching, payloads, state
from ..sources import batches, readers
from ..sources.storage import scratch
from ..streaming import jobs as J
from . import fixtures as X
from .q_documents import annotations
from .registry import query


def make_epub(title: str, chapters: list[str]) -> bytes:
    """A small book; its chapters stand in the manifest in reverse, so that only the spine gives their order."""
    items = [f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(chapters))]
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns="http://www.idpf.org/2007/opf"><metadata><dc:title>{html.escape(title)}</dc:title></metadata><manifest>{"".join(reversed(items))}</manifest><spine>{spine}</spine></package>')
        for i, c in enumerate(chapters):
            z.writestr(f"OPS/c{i}.xhtml", f"<html><body><p>{html.escape(c)}</p></body></html>")
    return out.getvalue()


@query("src3_epub", "SELECT doc_id, 'doc ' || doc_id AS title, md5(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS letters FROM documents WHERE text IS NOT NULL")
def src3(t):
    """Every text as a book of two chapters, parsed again; ASCII letters and digits keep their order."""

    def books(batches):
        for b in batches:
            rows = [(str(i), make_epub(f"doc {i}", [x[: len(x) // 2], x[len(x) // 2 :]])) for i, x in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = t.documents.where("text is not null").select("doc_id", "text").mapInPandas(books, "path string, content binary")
    return readers.parse_epubs(files).select(F.col("path").cast("long").alias("doc_id"), "title", F.md5(F.regexp_replace("markdown", "[^A-Za-z0-9]", "").cast("binary")).alias("letters"))


@query("src5_transcripts", "SELECT conv_id::VARCHAR AS video_id, count(*) AS segments, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def src5(t):
    """Turns as segments in JSON lines, read by the router."""
    path = scratch(t.spark, "transcripts")
    said = t.conversations.where("text is not null")
    said.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("double").alias("offset"), "text").write.json(path)
    n = said.groupBy(F.col("conv_id").cast("string").alias("video_id")).agg(F.count("*").alias("segments"))
    return readers.read(t.spark, "youtube", path).select(F.col("path").alias("video_id"), F.md5(F.col("markdown").cast("binary")).alias("digest")).join(n, "video_id").select("video_id", "segments", "digest")


@query("src8_vault_status", """SELECT '/vault/Documents/' || user_id || '-' || event_id // 40 AS folder, bool_or(event_type = 'view') AS content, bool_or(event_type = 'click') AS chunks, bool_or(event_type = 'purchase') AS metadata,
  bool_or(event_type = 'view') AND bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS complete FROM events GROUP BY 1""")
def src8(t):
    """A listing made from events: folders by user and 40 events, names by type."""
    name = F.when(F.col("event_type") == "view", "content.md").when(F.col("event_type") == "click", "chunks.json").when(F.col("event_type") == "purchase", "metadata.json").otherwise("cover.png")
    return readers.vault_status(t.events.select(F.concat(F.lit("/vault/Documents/"), "user_id", F.lit("-"), F.floor(F.col("event_id") / 40), F.lit("/"), name).alias("path")))


@query("src9_highlights", "SELECT document_id AS user_book_id, 'doc ' || document_id AS title, id, substr(content, 1, 60) AS text, start_offset::BIGINT AS location FROM doc_chunks", "doc_chunks")
def src9(t):
    """Chunks as an export of highlights, one book a line, read again."""
    path = scratch(t.spark, "highlights")
    h = F.struct("id", F.substring("content", 1, 60).alias("text"), F.lit(None).cast("string").alias("note"), F.col("start_offset").alias("location"), F.lit("offset").alias("location_type"))
    X.doc_chunks(t).groupBy(F.col("document_id").alias("user_book_id")).agg(F.collect_list(h).alias("highlights")).withColumn("title", F.concat(F.lit("doc "), "user_book_id")).write.json(path)
    return readers.highlights(t.spark, path).select("user_book_id", "title", "id", "text", "location")


@query("snk1_validated_write", """SELECT CASE WHEN o_totalprice < 200000 AND o_orderstatus <> 'P' THEN 'inserted' ELSE 'failed' END AS result, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def snk1(t):
    """Orders written with a rule, good and rejected rows read back from their folders."""
    path = scratch(t.spark, "validated")
    readers.write_validated(t.orders, F.expr("o_totalprice < 200000 and o_orderstatus <> 'P'"), f"{path}/good", f"{path}/bad")
    bad = t.spark.read.schema(t.orders.schema).json(f"{path}/bad")
    both = t.spark.read.parquet(f"{path}/good").select("o_orderkey", "o_custkey", F.lit("inserted").alias("result")).unionByName(bad.select("o_orderkey", "o_custkey", F.lit("failed").alias("result")))
    return both.groupBy("result").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.sum("o_custkey").alias("keys"))


def _order_rule(batch):
    """Refuses a batch that holds an order of too much or one that is pending."""
    price, status = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    if any(p is None or p >= 200000 or s == "P" for p, s in zip(price, status, strict=True)):
        raise batches.Refused("an order breaks the rule")


@query("snk1_batch_isolation", """SELECT CASE WHEN o_totalprice < 200000 AND o_orderstatus <> 'P' THEN 'inserted' ELSE 'failed' END AS result, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def snk1_isolation(t):
    """Orders written in batches to a store that refuses whole batches; rows that were let in are read back, the others are those refused one by one."""
    store = batches.FolderStore(scratch(t.spark, "store"), _order_rule)
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    batches.write_batches(rows, store, size=100)
    there = batches.read_committed(t.spark, store, rows.schema).select("o_orderkey", F.lit("inserted").alias("result"))
    refused = batches.read_refused(t.spark, store).select(F.col("row")["o_orderkey"].cast("long").alias("o_orderkey"), F.lit("failed").alias("result"))
    return there.unionByName(refused).groupBy("result").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("str25_highlight_injection", """WITH a AS (SELECT p.entity_id, p.document_id, p.start_offset AS s, p.end_offset AS e FROM components p JOIN components v ON v.entity_id = p.entity_id AND v.component_type = 'Visual' WHERE p.component_type = 'Position')
  SELECT c.id, a.entity_id::VARCHAR AS annotation_id, (least(e, end_offset) - greatest(s, start_offset))::INT AS chars, s >= start_offset AS begins, e <= end_offset AS ends
  FROM doc_chunks c JOIN a ON a.document_id = c.document_id AND a.s < c.end_offset AND a.e > c.start_offset""", "doc_chunks components")
def str25(t):
    """Chunks as paragraphs with every second half in emphasis; what the annotations mark, read back from the HTML."""
    c = X.doc_chunks(t)
    half = F.floor(F.length("content") / 2).cast("int")

    def escaped(x):
        return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    body = F.concat(F.lit("<p>"), escaped(F.substring("content", F.lit(1), half)), F.lit("<em>"), escaped(F.substring("content", half + 1, F.length("content"))), F.lit("</em></p>"))
    a = annotations(X.components(t)).withColumnRenamed("entity_id", "annotation_id")
    marked = highlights.highlight_blocks(c.select("id", "document_id", "start_offset", "end_offset", body.alias("html")), a)
    return highlights.marks_of(marked).drop("spans")


def cache_accesses(t):
    """Reads by 16 caches of users: a key a user, type and remainder."""
    return t.events.select((F.col("user_id") % 16).alias("cache"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.concat("user_id", F.lit("/"), "event_type", F.lit("/"), F.col("event_id") % 7).alias("key"), F.floor(F.col("value") * 10).alias("size"))


#: A day, 20 entries and 8,000 bytes, so that all three rules act on the events.
CACHE = {"ttl": 86_400_000, "entries": 20, "memory": 8_000}


@query("st7_cache")
def st7(t):
    return caching.simulate(cache_accesses(t), **CACHE)


@query("st7_cache_statistics")
def st7_statistics(t):
    return caching.statistics(caching.simulate(cache_accesses(t), **CACHE)).withColumn("hit_rate", F.round("hit_rate", 6))


def job_stream(events):
    """One job a user; errors by arithmetic."""
    e = F.col("event_id")
    error = F.when(e % 3 == 0, "network timeout").when(e % 3 == 1, "disk full").otherwise("temporary outage")
    return events.select(F.col("user_id").cast("long").alias("job_id"), "ts", "event_id", F.expr(J.STATUS).alias("status"), error.alias("error"))


@query("st3_retry_timers")
def st3(t):
    """Every change of the jobs over the stream of events, run to the end once."""
    return J.run_once(J.job_retries(job_stream(J.read_events(t.spark, f"{t.folder}/events.parquet"))))


STAGES = ["extract", "clean", "chunk", "embed"]


@query("st5_resume", """WITH j AS (SELECT doc_id AS id, doc_id % 3 AS resumes, CASE doc_id % 6 WHEN 0 THEN 'extract' WHEN 1 THEN 'clean' WHEN 2 THEN 'chunk' WHEN 3 THEN 'embed' WHEN 4 THEN 'unknown' END AS stage, text IS NOT NULL AND doc_id % 7 <> 0 AS there, doc_id % 5 = 0 AS bad FROM documents),
  r AS (SELECT *, CASE WHEN resumes = 0 THEN 'fresh' WHEN stage IS NULL OR stage = 'unknown' THEN 'no_stage' WHEN NOT there THEN 'missing' WHEN bad THEN 'changed' WHEN stage = 'embed' THEN 'done' ELSE 'resumed' END AS reason FROM j)
  SELECT id, reason, CASE WHEN reason = 'done' THEN NULL WHEN reason <> 'resumed' THEN 'extract' WHEN stage = 'extract' THEN 'clean' WHEN stage = 'clean' THEN 'chunk' ELSE 'embed' END AS next_stage FROM r""")
def st5(t):
    """A job a document whose checkpoint is its text; every seventh file is gone, every fifth hash is of something else."""
    d = F.col("doc_id")
    stage = F.get(F.array(*map(F.lit, [*STAGES, "unknown"])), (d % 6).cast("int"))
    sha = F.substring(F.sha2(F.when(d % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256), 1, 16)
    docs = t.documents.select("doc_id", "text", F.concat(F.lit("checkpoints/"), d).alias("path"))
    jobs = docs.select(d.alias("id"), (d % 3).alias("resume_count"), stage.alias("last_stage"), "path", sha.alias("hash"))
    return state.resume_plan(jobs, docs.where("doc_id % 7 <> 0").select("path", F.col("text").alias("content")), STAGES)


def matches(t):
    """What the offset matcher finds for chunks with squeezed white space."""
    c = X.doc_chunks(t).select("document_id", "chunk_index", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("content"))
    return matching.match_documents(c, t.documents.select(F.col("doc_id").alias("document_id"), "text"))


@query("a15_matcher_layers")
def a15_layers(t):
    """Layers over the matcher's own output, all documents (A15, A16)."""
    return matching.match_statistics(matches(t))


@query("a18_matcher_quality")
def a18_quality(t):
    """Tiers, recovery rate and mean confidence over the matcher's own output (A10, A18, A19, FLT12)."""
    return matching.match_quality(matches(t))


def _large(texts):
    """Stands for a model that is cut off by long texts and fails on a batch whose first text is of an odd kind."""
    if texts and sum(map(ord, texts[0][:40])) % 3 == 0:
        raise RuntimeError("out of memory")
    return [f"topic {len(set(t.split())) % 9}" if len(t) < 4000 else None for t in texts]


def _small(texts):
    if len(texts) > 24:
        raise RuntimeError("too many texts")
    return [f"topic {len(t) % 9}" if t else None for t in texts]


def _rules(texts):
    return ["general" for _ in texts]


#: Models are injected; these are stand-ins with fixed failures.
MODELS = [("large", _large), ("small", _small), ("rules", _rules)]


@query("enr2_breaker_chain")
def enr2_chain(t):
    """Every document through a chain of failing models: answer, model, models asked and number of errors; compared with a sequential loop in the tests."""
    out = fallback.answer_rows(t.documents.select("doc_id", "text"), "doc_id", "text", MODELS)
    return out.select("doc_id", "lane", "answer", "model", "asked", F.size("errors").alias("errors"))


PAYLOADS = """SELECT l_orderkey AS id, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey"""


def order_payloads(t):
    """A payload an order: its parts as chunk_ids; every 13th is cut off, every 17th holds a text instead, every 19th lacks them."""
    parts = F.array_sort(F.collect_set("l_partkey"))
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(parts.alias("parts"))
    i = F.col("id")
    whole = F.to_json(F.struct(F.col("parts").alias("chunk_ids"), F.struct((i % 7).alias("page")).alias("position"), (i % 2 == 0).alias("open")))
    odd = F.when(i % 13 == 0, F.concat(F.lit("{"), F.substring(whole, 3, 40))).when(i % 17 == 0, F.lit('{"chunk_ids": "all of them"}')).when(i % 19 == 0, F.lit('{"note": [1, 2]}'))
    return o.select("id", F.coalesce(odd, whole).alias("payload"), "parts")


@query("j27_payload_containment", f"""WITH o AS ({PAYLOADS}), g AS (SELECT id, parts FROM o WHERE id % 13 <> 0 AND id % 17 <> 0 AND id % 19 <> 0),
  s AS (SELECT id AS search, parts[1:2] AS wanted FROM o WHERE id % 50 = 0), e AS (SELECT id, parts, unnest(parts) AS part FROM g)
  SELECT search, id FROM s JOIN e ON e.part = s.wanted[1] WHERE len(s.wanted) = 1 OR list_contains(e.parts, s.wanted[2])""")
def j27_payload(t):
    """For the orders divisible by 50: the payloads whose chunk_ids hold the first two parts of each, by the table of elements."""
    p = order_payloads(t)
    table = payloads.PayloadTable.build(p.select("id", "payload"), "$.chunk_ids", "long", scratch(t.spark, "payloads"))
    return table.contains(p.where("id % 50 = 0").select(F.col("id").alias("search"), F.slice("parts", 1, 2).alias("values")))
