"""Queries over vectors, edges and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sets import jaccard
from ..functions.vectors import cosine
from ..operators import engines as E
from ..operators.vector_index import VectorIndex
from ..operators.vector_search import top_k_cosine
from ..operators.windows import global_rank, rank_within
from ..sources.storage import scratch
from . import fixtures as X
from .registry import query

R6 = lambda c, n=6: F.round(c, n)

_MATCH = """SELECT source, target, round(similarity, 6) AS similarity, rank FROM (
  SELECT a.id AS source, b.id AS target, list_cosine_similarity(a.embedding, b.embedding) AS similarity,
    row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.id)::INT AS rank
  FROM chunks a JOIN chunks b ON a.document_id <> b.document_id AND {where} list_cosine_similarity(a.embedding, b.embedding) > {t})
  WHERE rank <= {k}"""


@query("j1_match_chunks", _MATCH.format(where="b.is_current AND", t=0.3, k=5), "chunks")
def j1(t):
    c = X.chunks(t)
    return top_k_cosine(c, c.where("is_current"), 5, 0.3).withColumn("similarity", R6("similarity"))


@query("j2_semantic_engine", f"""SELECT source, target, 'semantic_similarity' AS connection_type, round(least(1.0, similarity + 0.3 * importance), 5) AS strength
  FROM ({_MATCH.format(where='a.is_current AND b.is_current AND', t=0.3, k=10).replace('round(similarity, 6) AS similarity', 'similarity')}) JOIN chunks ON target = id""", "chunks")
def j2(t):
    return E.semantic_similarity(X.chunks(t), threshold=0.3, k=10).withColumn("strength", R6("strength", 5))


@query("j5_indexed_exact", _MATCH.format(where="a.id % 50 = 0 AND", t=0.3, k=10), "chunks")
def j5_exact(t):
    """A batch of searches through the index, in its exact mode."""
    c = X.chunks(t)
    index = VectorIndex.build(c, scratch(t.spark, "index"))
    return index.search(c.where("id % 50 = 0"), 10, 0.3, exact=True).withColumn("similarity", R6("similarity"))


@query("j1_index_recall")
def j1_recall(t):
    """What the index finds of the ten best that a search of all rows gives, and the rows it reads for that, for each query."""
    c = X.chunks(t)
    q = c.where("id % 50 = 0")
    index = VectorIndex.build(c, scratch(t.spark, "index"))
    all_rows = top_k_cosine(q, c, 10, 0.3).select("source", "target")
    found = index.search(q, 10, 0.3).select("source", "target", F.lit(1).alias("hit"))
    met = all_rows.join(found, ["source", "target"], "left").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
    return index.rows_read(q).join(met, "id", "left").select(F.col("id").alias("source"), F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("found", F.lit(0)).alias("found"), "lists", "rows_read")


_CONTRA = """WITH p AS (SELECT a.id AS source, b.id AS target,
    len(list_intersect(a.concepts, b.concepts))::DOUBLE / len(list_distinct(list_concat(a.concepts, b.concepts))) AS j, abs(a.polarity - b.polarity) AS d, (a.importance + b.importance) / 2 AS i
  FROM chunks a JOIN chunks b ON a.document_id <> b.document_id AND a.is_current AND b.is_current AND a.polarity * b.polarity < 0),
  s AS (SELECT source, target, least(1.0, 0.4 * j + 0.4 * (d / 2) + 0.2 * i) AS strength FROM p WHERE j >= 0.5 AND d >= 0.3)
  SELECT source, target, 'contradiction_detection' AS connection_type, round(strength, 6) AS strength FROM s
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(strength, 9) DESC, target) <= 20"""


@query("j3_contradiction_engine", _CONTRA, "chunks")
def j3(t):
    return E.contradiction(X.chunks(t)).withColumn("strength", R6("strength"))


_BRIDGE = """WITH c AS (SELECT * FROM chunks WHERE is_current AND importance >= 0.6), s AS (SELECT * FROM c ORDER BY importance DESC, id LIMIT 50),
  m AS (SELECT s.id AS source, c.id AS target, s.importance AS i1, c.importance AS i2, len(list_intersect(s.concepts, c.concepts))::DOUBLE / len(list_distinct(list_concat(s.concepts, c.concepts))) AS j
    FROM s JOIN c ON s.document_id <> c.document_id AND s.domain <> c.domain QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY c.importance DESC, c.id) <= 10)
  SELECT source, target, 'thematic_bridge' AS connection_type, round(least(1.0, 0.7 * (i1 + i2) / 2 + 0.3 * j), 6) AS strength FROM m WHERE least(1.0, 0.7 * (i1 + i2) / 2 + 0.3 * j) >= 0.6"""


@query("j4_thematic_bridge_engine", _BRIDGE, "chunks")
def j4(t):
    return E.thematic_bridge(X.chunks(t)).withColumn("strength", R6("strength"))


@query("j5_vector_search_batch", _MATCH.format(where="a.id % 50 = 0 AND", t=-1, k=10), "chunks")
def j5(t):
    c = X.chunks(t)
    return top_k_cosine(c.where("id % 50 = 0"), c, 10, -1.0).withColumn("similarity", R6("similarity"))


_SEMANTIC = f"""SELECT source, target, 'semantic_similarity' AS connection_type, least(1.0, similarity + 0.3 * importance) AS strength
  FROM ({_MATCH.format(where='a.is_current AND b.is_current AND', t=0.3, k=10).replace('round(similarity, 6) AS similarity', 'similarity')}) JOIN chunks ON target = id"""


@query("set1_all_engines", f"""SELECT connection_type, count(*) AS edges, (sum(round(strength * 10000)::BIGINT)::DOUBLE / 10000)::DOUBLE AS strength FROM (
  SELECT source, target, connection_type, strength FROM ({_CONTRA})
  UNION ALL SELECT * FROM ({_BRIDGE}) UNION ALL SELECT * FROM ({_SEMANTIC})) GROUP BY connection_type""", "chunks")
def set1(t):
    """All engines of the registry; strengths are summed as whole numbers of ten-thousandths, in any order the same."""
    e = E.registry().run(X.chunks(t), {"semantic_similarity": {"threshold": 0.3, "k": 10}})
    return e.groupBy("connection_type").agg(F.count("*").alias("edges"), (F.sum(F.round(F.col("strength") * 10000).cast("long")).cast("double") / 10000).alias("strength"))


@query("snk3_upsert_edges", """SELECT source, target, connection_type, strength, batch FROM (
  SELECT source, target, connection_type, strength, 0 AS batch FROM edges UNION ALL SELECT source, target, connection_type, round(strength / 2, 4), 1 FROM edges WHERE source % 3 = 0
  UNION ALL SELECT source, target + 1000, connection_type, strength, 1 FROM edges WHERE source % 7 = 0)
  QUALIFY row_number() OVER (PARTITION BY source, target, connection_type ORDER BY batch DESC) = 1""", "edges")
def snk3(t):
    e = X.edges(t).select("source", "target", "connection_type", "strength")
    new = e.where("source % 3 = 0").withColumn("strength", F.round(F.col("strength") / 2, 4)).unionByName(e.where("source % 7 = 0").withColumn("target", F.col("target") + 1000))
    return E.upsert(e.withColumn("batch", F.lit(0)), new.withColumn("batch", F.lit(1)), ["source", "target", "connection_type"], "batch")


@query("j6_remap_edges", """WITH o AS (SELECT id, embedding FROM chunks WHERE NOT is_current), n AS (SELECT id, embedding FROM chunks WHERE is_current),
  b AS (SELECT o.id AS old, arg_max(n.id, (round(list_cosine_similarity(o.embedding, n.embedding), 9), -n.id)) AS new, max(round(list_cosine_similarity(o.embedding, n.embedding), 9)) AS sim FROM o, n GROUP BY o.id),
  e AS (SELECT source, target, connection_type FROM edges WHERE user_validated),
  r AS (SELECT e.*, coalesce(s.new, e.source) AS new_source, coalesce(g.new, e.target) AS new_target, least(coalesce(s.sim, 1.0), coalesce(g.sim, 1.0)) AS sim
    FROM e LEFT JOIN b s ON s.old = e.source LEFT JOIN b g ON g.old = e.target WHERE s.old IS NOT NULL OR g.old IS NOT NULL)
  SELECT source, target, connection_type, CASE WHEN sim >= 0.3 THEN new_source ELSE source END AS new_source, CASE WHEN sim >= 0.3 THEN new_target ELSE target END AS new_target, round(sim, 6) AS similarity,
    CASE WHEN sim >= 0.4 THEN 'success' WHEN sim >= 0.3 THEN 'review' ELSE 'lost' END AS outcome FROM r""", "chunks edges")
def j6(t):
    from ..operators.recovery import remap_edges

    c = X.chunks(t)
    return remap_edges(X.edges(t).where("user_validated"), c.where("not is_current"), c.where("is_current"), success=0.4, review=0.3).withColumn("similarity", R6("similarity"))


@query("j28_thought_recovery", """WITH o AS (SELECT id, embedding FROM chunks WHERE NOT is_current), n AS (SELECT id, embedding FROM chunks WHERE is_current),
  m AS (SELECT o.id AS spark_id, n.id AS chunk_id, round(list_cosine_similarity(o.embedding, n.embedding), 9) AS s, row_number() OVER (PARTITION BY o.id ORDER BY round(list_cosine_similarity(o.embedding, n.embedding), 9) DESC, n.id) AS r FROM o, n)
  SELECT spark_id, list(chunk_id ORDER BY r) AS chunk_ids, round(max(s), 6) AS similarity, CASE WHEN max(s) > 0.4 THEN 'success' WHEN max(s) > 0.3 THEN 'review' ELSE 'lost' END AS outcome FROM m WHERE r <= 3 GROUP BY spark_id""", "chunks")
def j28(t):
    from ..operators.recovery import recover_thoughts

    c = X.chunks(t)
    return recover_thoughts(c.where("not is_current"), c.where("is_current"), success=0.4, review=0.3).withColumn("similarity", R6("similarity"))


@query("j7_annotation_connections", "SELECT DISTINCT source, target, connection_type, strength FROM edges WHERE source IN (SELECT vec_id FROM embeddings WHERE label = 3) OR target IN (SELECT vec_id FROM embeddings WHERE label = 3)", "edges")
def j7(t):
    ids = t.embeddings.where("label = 3").select(F.col("vec_id").alias("i"))
    e = X.edges(t).select("source", "target", "connection_type", "strength")
    return e.join(ids, F.col("source") == F.col("i"), "left_semi").union(e.join(ids, F.col("target") == F.col("i"), "left_semi")).distinct()


@query("j16_document_connections", """SELECT e.source, e.target, e.connection_type, e.strength, s.document_id AS source_document, g.document_id AS target_document, s.chunk_index AS source_index, g.chunk_index AS target_index
  FROM edges e JOIN chunks s ON s.id = e.source JOIN chunks g ON g.id = e.target WHERE s.document_id = 2 OR g.document_id = 2""", "chunks edges")
def j16(t):
    c = X.chunk_numbers(t)
    s = c.select(F.col("id").alias("source"), F.col("document_id").alias("source_document"), F.col("chunk_index").alias("source_index"))
    g = c.select(F.col("id").alias("target"), F.col("document_id").alias("target_document"), F.col("chunk_index").alias("target_index"))
    return X.edges(t).select("source", "target", "connection_type", "strength").join(s, "source").join(g, "target").where("source_document = 2 or target_document = 2")


@query("j17_inherited_connections", """WITH o AS (SELECT vec_id AS spark_id, vec_id AS origin FROM embeddings WHERE vec_id % 11 = 0),
  i AS (SELECT spark_id, target AS chunk_id, round(strength * 0.7, 6) AS w, 'inherited' AS kind FROM o JOIN edges ON source = origin WHERE strength >= 0.6 QUALIFY row_number() OVER (PARTITION BY spark_id ORDER BY strength DESC, target) <= 10),
  u AS (SELECT spark_id, origin AS chunk_id, 1.0 AS w, 'origin' AS kind FROM o UNION ALL SELECT spark_id, (origin * 3) % 97, 0.9, 'mention' FROM o UNION ALL SELECT * FROM i)
  SELECT spark_id, chunk_id, max(w)::DOUBLE AS weight, arg_max(kind, (w, kind)) AS kind FROM u GROUP BY spark_id, chunk_id""", "edges")
def j17(t):
    from ..operators.graph import spark_connections

    o = t.embeddings.where("vec_id % 11 = 0").select(F.col("vec_id").alias("spark_id"), F.col("vec_id").alias("origin"))
    return spark_connections(o, o.select("spark_id", ((F.col("origin") * 3) % 97).alias("chunk_id")), X.edges(t))


@query("j20_row_level_security", "SELECT source, target, connection_type FROM edges e WHERE EXISTS (SELECT 1 FROM chunks c JOIN doc_rows d ON d.id = c.document_id WHERE c.id = e.source AND d.user_id = 3)", "chunks edges doc_rows")
def j20(t):
    own = X.chunks(t).select(F.col("id").alias("source"), "document_id").join(X.doc_rows(t).where("user_id = 3").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return X.edges(t).join(own, "source", "left_semi").select("source", "target", "connection_type")


@query("j24_newer_documents", "SELECT a.id, count(b.id) AS newer FROM doc_rows a LEFT JOIN doc_rows b ON a.user_id = b.user_id AND b.created_at > a.created_at GROUP BY a.id", "doc_rows")
def j24(t):
    """How many documents of the same owner are newer: by rank, not by a self join."""
    rows = X.doc_rows(t).select("id", "user_id", "created_at")
    ranked = rank_within(rows, "user_id", [F.desc("created_at"), F.col("id")], ties=[F.col("created_at")])
    return ranked.select("id", (F.col("rank") - 1).cast("long").alias("newer"))


@query("j25_vault_edges_direct", """WITH v AS (SELECT source % 5 AS vault, e.*, s.id IS NOT NULL AND g.id IS NOT NULL AS ok FROM edges e LEFT JOIN (SELECT id FROM chunks WHERE id % 23 <> 0) s ON s.id = e.source LEFT JOIN (SELECT id FROM chunks WHERE id % 23 <> 0) g ON g.id = e.target)
  SELECT vault, CASE WHEN bool_and(ok) THEN 'direct' ELSE 'remap' END AS mode, count(*) AS edges, sum(ok::INT)::BIGINT AS resolved FROM v GROUP BY vault""", "chunks edges")
def j25(t):
    c = X.chunks(t).where("id % 23 <> 0").select("id")
    e = X.edges(t).withColumn("vault", F.col("source") % 5)
    e = e.join(c.select(F.col("id").alias("s")), F.col("source") == F.col("s"), "left").join(c.select(F.col("id").alias("g")), F.col("target") == F.col("g"), "left")
    ok = F.col("s").isNotNull() & F.col("g").isNotNull()
    return e.groupBy("vault").agg(F.when(F.bool_and(ok), "direct").otherwise("remap").alias("mode"), F.count("*").alias("edges"), F.count_if(ok).alias("resolved"))


@query("a1_count_connections", """SELECT c.document_id, count(*) AS total, count(*) FILTER (e.strength >= 0.6) AS strong, count(*) FILTER (e.connection_type = 'thematic_bridge') AS bridges
  FROM edges e JOIN chunks c ON c.id = e.source GROUP BY c.document_id""", "chunks edges")
def a1(t):
    return X.edges(t).join(X.chunks(t).select(F.col("id").alias("source"), "document_id"), "source").groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("strength") >= 0.6).alias("strong"), F.count_if(F.col("connection_type") == "thematic_bridge").alias("bridges"))


@query("a2_detection_stats", """WITH k AS (SELECT source, count(*) AS n FROM edges GROUP BY source)
  SELECT document_id, count(*) FILTER (is_current) AS chunks, count(*) FILTER (is_current AND id % 3 = 0) AS detected,
    round(100.0 * count(*) FILTER (is_current AND id % 3 = 0) / nullif(count(*) FILTER (is_current), 0), 2)::DOUBLE AS rate, round(avg(k.n), 4) AS avg_connections FROM chunks LEFT JOIN k ON k.source = id GROUP BY document_id""", "chunks edges")
def a2(t):
    n = X.edges(t).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    cur, det = F.count_if("is_current"), F.count_if(F.col("is_current") & (F.col("id") % 3 == 0))
    return X.chunks(t).join(n, "id", "left").groupBy("document_id").agg(cur.alias("chunks"), det.alias("detected"), F.round(F.try_divide(100.0 * det, cur), 2).alias("rate"), F.round(F.avg("n"), 4).alias("avg_connections"))


@query("a3_enrichment_stats", """SELECT document_id, count(*) AS total, count(*) FILTER (id % 4 = 0) AS enriched, count(*) FILTER (id % 4 = 1) AS skipped, count(*) FILTER (id % 4 > 1) AS pending, count(*) FILTER (NOT is_current) AS old FROM chunks GROUP BY document_id""", "chunks")
def a3(t):
    m = F.col("id") % 4
    return X.chunks(t).groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(m == 0).alias("enriched"), F.count_if(m == 1).alias("skipped"), F.count_if(m > 1).alias("pending"), F.count_if(~F.col("is_current")).alias("old"))


def _scoring(method: str, norm: str) -> str:
    how = {"sum": "least(1.0, sum(strength))", "average": "avg(strength)", "max": "max(strength)", "harmonic_mean": "CASE WHEN min(strength) <= 0 THEN 0.0 ELSE count(*) / sum(CASE WHEN strength > 0 THEN 1 / strength END) END"}[method]
    n = {"linear": "least(1.0, greatest(0.0, c))", "sigmoid": "1 / (1 + exp(-10 * (c - 0.5)))", "softmax": "exp(c) / (exp(c) + exp(1 - c))"}[norm]
    return f"""WITH o AS (SELECT target, connection_type, {how} AS c FROM edges GROUP BY ALL), n AS (SELECT *, {n} AS n, CASE connection_type WHEN 'semantic_similarity' THEN 0.25 WHEN 'contradiction_detection' THEN 0.4 ELSE 0.35 END::DOUBLE AS w FROM o),
      s AS (SELECT target, round(sum(n * w) / sum(w) + 1e-9, 6) AS score, count(*) AS engines FROM n GROUP BY target)
      SELECT *, row_number() OVER (ORDER BY score DESC, target)::INT AS rank FROM s"""


def _score(method: str, norm: str):
    def f(t):
        # scores that end in a half at the sixth place go up, in whatever order their parts were added
        s = E.combine(X.edges(t), E.WEIGHTS, method, norm).select("target", R6(F.col("score") + 1e-9).alias("score"), "engines")
        return global_rank(s, [F.desc("score"), F.asc("target")]).withColumn("rank", F.col("rank").cast("int"))

    return f


for _m, _n in (("average", "linear"), ("sum", "sigmoid"), ("max", "softmax"), ("harmonic_mean", "linear")):
    query(f"a11_score_{_m}_{_n}", _scoring(_m, _n), "edges")(_score(_m, _n))


@query("a12_edge_counts", "SELECT connection_type, count(*) AS edges, count(*) - count(DISTINCT (source, target)) AS repeated FROM edges GROUP BY connection_type", "edges")
def a12(t):
    pairs = X.edges(t).groupBy("connection_type", "source", "target").agg(F.count("*").alias("c"))
    return pairs.groupBy("connection_type").agg(F.sum("c").alias("edges"), (F.sum("c") - F.count("*")).alias("repeated"))


@query("a22_edges_by_type", "SELECT source, connection_type, count(*) AS n, string_agg(target::VARCHAR, ',' ORDER BY strength DESC, target) AS targets FROM edges GROUP BY source, connection_type", "edges")
def a22(t):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "target")))
    return X.edges(t).groupBy("source", "connection_type").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(rows, lambda x: x["target"].cast("string"))).alias("targets"))


@query("w1_top_per_source", "SELECT source, target, strength FROM edges QUALIFY row_number() OVER (PARTITION BY source ORDER BY strength DESC, target) <= 2", "edges")
def w1(t):
    return E.best_per(X.edges(t), "source", 2, "strength", "target").select("source", "target", "strength")


@query("w2_global_rank", "SELECT source, target, row_number() OVER (ORDER BY strength DESC, source, target)::BIGINT AS rank FROM edges", "edges")
def w2(t):
    return global_rank(X.edges(t), [F.desc("strength"), F.asc("source"), F.asc("target")]).select("source", "target", "rank")


@query("w13_best_edge_per_target", "SELECT target, max(strength) AS strength, arg_max(source, (strength, -source)) AS source FROM edges GROUP BY target", "edges")
def w13(t):
    at = F.struct("strength", (-F.col("source")).alias("s"))
    return X.edges(t).groupBy("target").agg(F.max("strength").alias("strength"), F.max_by("source", at).alias("source"))


@query("flt17_connections_for_chunks", "SELECT source, target, strength FROM edges WHERE source % 2 = 0 ORDER BY strength DESC, source, target LIMIT 100", "edges")
def flt17(t):
    return X.edges(t).where("source % 2 = 0").orderBy(F.desc("strength"), "source", "target").limit(100).select("source", "target", "strength")


@query("flt18_panel_filter", """WITH f AS (SELECT *, round(strength * CASE connection_type WHEN 'semantic_similarity' THEN 0.25 WHEN 'contradiction_detection' THEN 0.4 ELSE 0.35 END::DOUBLE, 6) AS score FROM edges WHERE connection_type <> 'thematic_bridge')
  SELECT source, target, connection_type, score FROM f WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY score DESC, connection_type) = 1""", "edges")
def flt18(t):
    w = F.create_map(*[F.lit(x) for kv in E.WEIGHTS.items() for x in kv])[F.col("connection_type")]
    e = X.edges(t).where("connection_type <> 'thematic_bridge'").withColumn("score", R6(F.col("strength") * w)).where("score >= 0.1")
    r = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("score"), "connection_type"))
    return e.withColumn("r", r).where("r = 1").select("source", "target", "connection_type", "score")


@query("flt6_source_selection", "SELECT id, document_id FROM chunks WHERE document_id = 1 AND embedding IS NOT NULL AND is_current AND id IN (SELECT source FROM edges)", "chunks edges")
def flt6(t):
    return X.chunks(t).where("document_id = 1 and embedding is not null and is_current").join(X.edges(t).select(F.col("source").alias("id")), "id", "left_semi").select("id", "document_id")


@query("flt4_undetected_chunks", "SELECT id, document_id, chunk_index FROM chunks WHERE is_current AND id NOT IN (SELECT source FROM edges WHERE strength > 0.5)", "chunks edges")
def flt4(t):
    done = X.edges(t).where("strength > 0.5").select(F.col("source").alias("id"))
    left = X.chunks(t).where("is_current").join(done, "id", "left_anti").select("id")
    return X.chunk_numbers(t).join(left, "id").select("id", "document_id", "chunk_index")


def next_chunks(t):
    """id and other: each chunk and the one after it in its document, joined on numbers that no value is hot in."""
    c = X.chunk_numbers(t)
    after = c.select("document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("id").alias("other"))
    return c.join(after, ["document_id", "chunk_index"]).select("id", "other")


@query("set3_array_jaccard", "SELECT a.id, b.id AS other, round(len(list_intersect(a.concepts, b.concepts))::DOUBLE / len(list_distinct(list_concat(a.concepts, b.concepts))), 6) AS jaccard FROM chunks a JOIN chunks b ON b.document_id = a.document_id AND b.chunk_index = a.chunk_index + 1", "chunks")
def set3(t):
    c = next_chunks(t)
    own = X.chunks(t).select("id", "concepts")
    c = c.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("concepts").alias("oc")), "other")
    return c.select("id", "other", R6(jaccard(F.col("concepts"), F.col("oc"))).alias("jaccard"))


@query("set4_distinct_ids", "SELECT DISTINCT target AS id FROM edges UNION SELECT source FROM edges WHERE user_starred", "edges")
def set4(t):
    e = X.edges(t)
    return e.select(F.col("target").alias("id")).union(e.where("user_starred").select("source")).distinct()


@query("math_cosine_adjacent", "SELECT id, round(list_cosine_similarity(embedding, nxt), 6) AS similarity FROM (SELECT id, embedding, lead(embedding) OVER (PARTITION BY document_id ORDER BY chunk_index) AS nxt FROM chunks) WHERE nxt IS NOT NULL", "chunks")
def cos(t):
    own = X.chunks(t).select("id", "embedding")
    c = next_chunks(t).join(own, "id").join(own.select(F.col("id").alias("other"), F.col("embedding").alias("n")), "other")
    return c.where("n is not null").select("id", R6(cosine(F.col("embedding"), F.col("n"))).alias("similarity"))


@query("d3_reprocess_smart", "SELECT source, target, connection_type FROM edges WHERE NOT ((source IN (SELECT id FROM chunks WHERE document_id = 4) OR target IN (SELECT id FROM chunks WHERE document_id = 4)) AND user_validated IS NOT DISTINCT FROM false)", "chunks edges")
def d3(t):
    from ..operators.state import reprocess_edges

    ids = X.chunks(t).where("document_id = 4").select("id")
    return reprocess_edges(X.edges(t), ids, "smart").select("source", "target", "connection_type")


@query("d3_reprocess_all", "SELECT source, target, connection_type FROM edges WHERE source NOT IN (SELECT id FROM chunks WHERE document_id = 4) AND target NOT IN (SELECT id FROM chunks WHERE document_id = 4)", "chunks edges")
def d3a(t):
    from ..operators.state import reprocess_edges

    return reprocess_edges(X.edges(t), X.chunks(t).where("document_id = 4").select("id"), "all").select("source", "target", "connection_type")


@query("d4_edge_feedback", """WITH f AS (SELECT (user_id * 7) % 97 AS source, event_type, ts, event_id FROM events WHERE event_type IN ('view', 'error', 'purchase')),
  l AS (SELECT source, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'purchase') AS verdict, bool_or(event_type = 'purchase') AS starred FROM f GROUP BY source)
  SELECT e.source, e.target, e.connection_type, coalesce(CASE l.verdict WHEN 'view' THEN true WHEN 'error' THEN false END, e.user_validated) AS user_validated, e.user_starred OR coalesce(l.starred, false) AS user_starred FROM edges e LEFT JOIN l ON l.source = e.source""", "edges")
def d4(t):
    f = t.events.where("event_type in ('view', 'error', 'purchase')").select(((F.col("user_id") * 7) % 97).alias("source"), "event_type", "ts", "event_id")
    verdict = F.max_by(F.when(F.col("event_type") != "purchase", F.col("event_type")), F.when(F.col("event_type") != "purchase", F.struct("ts", "event_id")))
    last = f.groupBy("source").agg(verdict.alias("verdict"), F.bool_or(F.col("event_type") == "purchase").alias("starred"))
    v = F.when(F.col("verdict") == "view", True).when(F.col("verdict") == "error", False)
    return X.edges(t).join(last, "source", "left").select("source", "target", "connection_type", F.coalesce(v, "user_validated").alias("user_validated"), (F.col("user_starred") | F.coalesce("starred", F.lit(False))).alias("user_starred"))


@query("d5_mark_detected", "SELECT id, is_current, id IN (SELECT source FROM edges) AS detected FROM chunks", "chunks edges")
def d5(t):
    done = X.edges(t).select(F.col("source").alias("id")).distinct().withColumn("d", F.lit(True))
    return X.chunks(t).join(done, "id", "left").select("id", "is_current", F.coalesce("d", F.lit(False)).alias("detected"))


@query("d13_delete_cascade", """SELECT 'chunks' AS kind, count(*) AS left_rows FROM chunks WHERE document_id <> 5 UNION ALL
  SELECT 'edges', count(*) FROM edges WHERE source NOT IN (SELECT id FROM chunks WHERE document_id = 5) AND target NOT IN (SELECT id FROM chunks WHERE document_id = 5)""", "chunks edges")
def d13(t):
    from ..operators.state import delete_document

    c, e = delete_document(X.chunks(t), X.edges(t), 5)
    return c.groupBy().agg(F.lit("chunks").alias("kind"), F.count("*").alias("left_rows")).unionByName(e.groupBy().agg(F.lit("edges").alias("kind"), F.count("*").alias("left_rows")))
