"""Queries over cards, decks, reviews, jobs and time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.windows import exact_percentiles
from ..operators import temporal as T
from ..operators.state import import_review, upsert_weights
from . import fixtures as X
from .registry import query

CARDS_AT, EVENTS_AT = "2000-01-01", "2024-01-30"
_now = lambda s: F.lit(s).cast("timestamp")


def study_filter(cards, *, as_of, due=None, deck=None, document=None, chunks=None, tags=None, status=None, difficulty=None, next_review=None, never_studied=None, failed=None):
    """A conjunction of what is given; chunks: any overlap; tags: all contained; ranges are closed pairs."""
    c = cards
    if due:
        c = c.where(F.col("next_review") <= as_of)
    if deck is not None:
        c = c.where(F.col("deck_id") == deck)
    if document is not None:
        c = c.where(F.col("document_id") == document)
    if chunks is not None:
        c = c.where(F.arrays_overlap("chunk_ids", F.array(*[F.lit(x).cast("long") for x in chunks])))
    if tags is not None:
        c = c.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if status is not None:
        c = c.where(F.col("status").isin(*status))
    if difficulty is not None:
        c = c.where(F.col("difficulty").between(*difficulty))
    if next_review is not None:
        c = c.where(F.col("next_review").between(*[_now(x) for x in next_review]))
    if never_studied:
        c = c.where("last_review is null")
    if failed:
        c = c.where("lapses > 0")
    return c


@query("flt7_study_filter", f"""SELECT card_id, deck_id, next_review FROM cards WHERE next_review <= TIMESTAMP '{CARDS_AT}' AND status IN ('active', 'draft') AND difficulty BETWEEN 2 AND 7 AND list_contains(tags, 'F') AND len(list_intersect(chunk_ids, [1, 2, 3, 5, 8, 13, 21, 34])) > 0 AND lapses > 0
  ORDER BY next_review, card_id LIMIT 50""", "cards")
def flt7(t):
    c = study_filter(X.cards(t), as_of=_now(CARDS_AT), due=True, status=("active", "draft"), difficulty=(2, 7), tags=("F",), chunks=(1, 2, 3, 5, 8, 13, 21, 34), failed=True)
    return c.orderBy("next_review", "card_id").limit(50).select("card_id", "deck_id", "next_review")


@query("flt8_due_cards", f"SELECT card_id, deck_id, document_id, next_review FROM cards WHERE status = 'active' AND next_review <= TIMESTAMP '1993-01-01' AND deck_id = 'Brand#11'", "cards")
def flt8(t):
    return study_filter(X.cards(t), as_of=_now("1993-01-01"), due=True, deck="Brand#11", status=("active",)).select("card_id", "deck_id", "document_id", "next_review")


@query("j9_flashcards_cache", """SELECT p.entity_id, p.document_id, p.start_offset, v.value AS color, c.value AS note, CASE WHEN c.value IS NULL THEN 'draft' ELSE 'active' END AS status
  FROM components p JOIN components v ON v.entity_id = p.entity_id AND v.component_type = 'Visual' LEFT JOIN components c ON c.entity_id = p.entity_id AND c.component_type = 'Content' WHERE p.component_type = 'Position'""", "components")
def j9(t):
    from .q_documents import annotations

    return annotations(X.components(t)).select("entity_id", "document_id", "start_offset", "color", "note", F.when(F.col("note").isNull(), "draft").otherwise("active").alias("status"))


@query("j18_decks_with_stats", f"""SELECT n_nationkey AS deck_id, n_name AS name, r_name AS parent, count(c_custkey) AS cards, count(*) FILTER (c_acctbal < 0) AS due, count(*) FILTER (c_mktsegment = 'BUILDING') AS active
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def j18(t):
    stats = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("cards"), F.count_if(F.col("c_acctbal") < 0).alias("due"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("active"))
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(stats, "n_nationkey", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select(F.col("n_nationkey").alias("deck_id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"), z("cards"), z("due"), z("active"))


@query("j18_deck_paths", "SELECT n_nationkey AS deck_id, r_name || '/' || n_name AS path, 2 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 1000, r_name, 1 FROM region")
def deck_paths(t):
    """Adjacency list to paths, by a recursive query."""
    r = t.region.select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    r.unionByName(t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent"), F.col("n_name").alias("name"))).createOrReplaceTempView("_skein_decks")
    return t.spark.sql("""WITH RECURSIVE p(id, path, depth) AS (SELECT id, name, 1 FROM _skein_decks WHERE parent IS NULL
      UNION ALL SELECT d.id, concat(p.path, '/', d.name), p.depth + 1 FROM _skein_decks d JOIN p ON d.parent = p.id) SELECT id AS deck_id, path, depth FROM p""")


@query("a7_deck_detail", f"""SELECT deck_id, count(*) AS cards, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'draft') AS drafts, count(*) FILTER (status = 'active' AND next_review <= TIMESTAMP '{CARDS_AT}') AS due, round(sum(CASE WHEN lapses > 0 THEN difficulty ELSE 0 END) / count(*), 4) AS avg_difficulty FROM cards GROUP BY deck_id""", "cards")
def a7(t):
    d = F.coalesce(F.when(F.col("lapses") > 0, F.col("difficulty")), F.lit(0.0))
    a = F.col("status") == "active"
    return X.cards(t).groupBy("deck_id").agg(F.count("*").alias("cards"), F.count_if(a).alias("active"), F.count_if(F.col("status") == "draft").alias("drafts"), F.count_if(a & (F.col("next_review") <= _now(CARDS_AT))).alias("due"), F.round(F.avg(d), 4).alias("avg_difficulty"))


@query("a8_session_fold", """SELECT user_id, day, count(*) AS cards_reviewed, sum(time_ms)::BIGINT AS total_time_ms, sum(time_ms)::BIGINT // count(*) AS average_time_per_card_ms, count(*) FILTER (rating = 'again') AS again, count(*) FILTER (rating = 'hard') AS hard, count(*) FILTER (rating = 'good') AS good, count(*) FILTER (rating = 'easy') AS easy FROM reviews GROUP BY user_id, day""", "reviews")
def a8(t):
    n, s = F.count("*"), F.sum("time_ms")
    return X.reviews(t).groupBy("user_id", "day").agg(n.alias("cards_reviewed"), s.alias("total_time_ms"), F.floor(s / n).alias("average_time_per_card_ms"), *[F.count_if(F.col("rating") == r).alias(r) for r in ("again", "hard", "good", "easy")])


@query("a4_study_statistics", f"""SELECT user_id, count(*) FILTER (day = DATE '{EVENTS_AT}') AS today, count(*) FILTER (day > DATE '{EVENTS_AT}' - 7) AS week, round(count(*) FILTER (rating IN ('good', 'easy')) / count(*)::DOUBLE, 6) AS retention, round(avg(time_ms), 4) AS avg_ms FROM reviews GROUP BY user_id""", "reviews")
def a4(t):
    at = F.lit(EVENTS_AT).cast("date")
    return X.reviews(t).groupBy("user_id").agg(F.count_if(F.col("day") == at).alias("today"), F.count_if(F.col("day") > F.date_sub(at, 7)).alias("week"), F.round(F.count_if(F.col("rating").isin("good", "easy")) / F.count("*"), 6).alias("retention"), F.round(F.avg("time_ms"), 4).alias("avg_ms"))


@query("a4_due_forecast", f"""SELECT d::DATE AS day, count(card_id) AS due FROM (SELECT unnest(generate_series(TIMESTAMP '{CARDS_AT}' - INTERVAL 3000 DAY, TIMESTAMP '{CARDS_AT}' - INTERVAL 2994 DAY, INTERVAL 1 DAY)) AS d) LEFT JOIN cards ON next_review::DATE = d::DATE AND status = 'active' GROUP BY 1""", "cards")
def forecast(t):
    days = t.spark.sql(f"SELECT explode(sequence(date_sub(DATE '{CARDS_AT}', 3000), date_sub(DATE '{CARDS_AT}', 2994))) AS day")
    n = X.cards(t).where("status = 'active'").groupBy(F.to_date("next_review").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("due"))


@query("a5_streak", f"""WITH d AS (SELECT DISTINCT user_id, day FROM reviews), i AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS i FROM d),
  r AS (SELECT user_id, max(day) AS last, count(*) AS n FROM i GROUP BY user_id, i) SELECT user_id, coalesce(max(CASE WHEN last = DATE '{EVENTS_AT}' THEN n END), 0) AS streak FROM r GROUP BY user_id""", "reviews")
def a5(t):
    return T.streaks(X.reviews(t), "user_id", "day", EVENTS_AT)


@query("a6_upcoming_reviews", f"""SELECT next_review::DATE AS day, CASE next_review::DATE - DATE '1995-03-01' WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' ELSE strftime(next_review, '%a') END AS label, count(*) AS n FROM cards WHERE next_review::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-07' GROUP BY 1, 2""", "cards")
def a6(t):
    d = F.to_date("next_review")
    gap = F.datediff(d, F.lit("1995-03-01").cast("date"))
    c = X.cards(t).where(gap.between(0, 6)).groupBy(d.alias("day")).agg(F.count("*").alias("n"))
    gap = F.datediff("day", F.lit("1995-03-01").cast("date"))
    return c.select("day", F.when(gap == 0, "Today").when(gap == 1, "Tomorrow").otherwise(F.date_format("day", "EEE")).alias("label"), "n")


@query("a13_preference_statistics", """SELECT event_type AS engine, count(DISTINCT user_id) AS users, round(sum(value) / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean_weight FROM events GROUP BY event_type""")
def a13(t):
    g = t.events.groupBy("event_type", "user_id").agg(F.sum("value").alias("s")).groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("users"), F.sum("s").alias("s"))
    total = t.events.agg(F.count_distinct("user_id").alias("total"))  # one row
    return g.join(F.broadcast(total)).select("engine", "users", F.round(F.col("s") / F.col("total"), 6).alias("mean_weight"))


@query("a14_weight_normalisation", """WITH s AS (SELECT user_id, sum(value) FILTER (event_type = 'view') AS a, sum(value) FILTER (event_type = 'click') AS b, sum(value) FILTER (event_type = 'error') AS c FROM events GROUP BY user_id),
  z AS (SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM s)
  SELECT user_id, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 1 / 3.0 END, 6)::DOUBLE AS view, round(CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 1 / 3.0 END, 6)::DOUBLE AS click, round(CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 1 / 3.0 END, 6)::DOUBLE AS error FROM z""")
def a14(t):
    kinds = ("view", "click", "error")
    g = t.events.groupBy("user_id").agg(F.create_map(*[x for k in kinds for x in (F.lit(k), F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)))]).alias("m"))
    w = normalised(F.col("m"))
    return g.select("user_id", *[F.round(w[k], 6).alias(k) for k in kinds])


def normalised(weights):
    """A map of weights divided by their sum; equal weights where that is 0."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(weights, lambda _, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(weights)))


@query("a17_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def a17(t):
    p = exact_percentiles(t.events, "event_type", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).join(p.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type"))).drop("_type")


@query("a23_custom_presets", "SELECT user_id, list_sort(list_concat(list_filter(list(DISTINCT event_type), lambda x: x <> 'view'), ['mine'])) AS presets, len(list_filter(list(DISTINCT event_type), lambda x: x <> 'view')) + 1 AS n FROM events GROUP BY user_id")
def a23(t):
    p = F.array_sort(F.concat(F.filter(F.collect_set("event_type"), lambda x: x != "view"), F.array(F.lit("mine"))))
    return t.events.groupBy("user_id").agg(p.alias("presets")).withColumn("n", F.size("presets"))


@query("a24_cost_estimate", "SELECT doc_id, ceil(n_chars / 1500.0)::BIGINT AS pages, round(ceil(n_chars / 1500.0) * 0.002 + ceil(n_chars / 2000.0) * 0.0005, 6)::DOUBLE AS cost FROM documents")
def a24(t):
    p, c = F.ceil(F.col("n_chars") / 1500), F.ceil(F.col("n_chars") / 2000)
    return t.documents.select("doc_id", p.alias("pages"), F.round(p * 0.002 + c * 0.0005, 6).alias("cost"))


@query("w7_temporal_clusters", """WITH g AS (SELECT user_id, ts, event_id, epoch_us(ts) / 1e6 AS s, coalesce((epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w > 86400)::INT, 0) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g), k AS (SELECT user_id, cluster, count(*) AS n, min(s) AS a, max(s) AS b FROM c GROUP BY user_id, cluster)
  SELECT user_id, cluster, n, a AS start_s, b AS end_s, round((a + b) / 2, 3) AS centroid_s, round(CASE WHEN n = 1 THEN 0.0 WHEN b = a THEN 1.0 ELSE n / greatest(1.0, (b - a) / 3600) END, 6)::DOUBLE AS density FROM k""")
def w7(t):
    return T.clusters(t.events, "user_id", "ts", "event_id").withColumn("centroid_s", F.round("centroid_s", 3)).withColumn("density", F.round("density", 6))


@query("w8_periodicity", """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9 AS gap FROM events),
  s AS (SELECT user_id, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS sd, min(gap) AS lo, max(gap) AS hi FROM g GROUP BY user_id HAVING count(*) >= 3)
  SELECT user_id, n, round(m, 5) AS mean_hours, round(CASE WHEN m > 0 THEN sd / m END, 5) AS cv, CASE WHEN sd / m < 0.3 THEN 'periodic' WHEN hi > 10 * lo AND lo < 1 THEN 'burst' ELSE 'irregular' END AS kind FROM s""")
def w8(t):
    return T.periodicity(t.events, "user_id", "ts", "event_id").withColumn("mean_hours", F.round("mean_hours", 5)).withColumn("cv", F.round("cv", 5))


@query("st2_job_latest_state", "SELECT job_id, user_id, status, created_at, updated_at, retry_count FROM jobs", "jobs")
def st2(t):
    return X.jobs(t).select("job_id", "user_id", "status", "created_at", "updated_at", "retry_count")


@query("flt14_recent_jobs", "SELECT job_id, status, updated_at FROM jobs WHERE updated_at > TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR ORDER BY updated_at DESC, job_id LIMIT 500", "jobs")
def flt14(t):
    return X.jobs(t).where(F.col("updated_at") > _now(EVENTS_AT) - F.expr("interval 24 hours")).orderBy(F.desc("updated_at"), "job_id").limit(500).select("job_id", "status", "updated_at")


@query("flt15_job_pick", """WITH j AS (SELECT *, updated_at + least(power(2, retry_count), 30)::INT * INTERVAL 1 MINUTE AS next_retry_at FROM jobs),
  p AS (SELECT job_id, created_at, 1 AS prio FROM j WHERE status = 'pending' OR (status = 'failed' AND next_retry_at <= TIMESTAMP '2024-01-30') UNION ALL SELECT job_id, created_at, 2 FROM j WHERE status = 'processing' AND updated_at < TIMESTAMP '2024-01-30' - INTERVAL 30 MINUTE)
  SELECT job_id, prio FROM p ORDER BY prio, created_at, job_id LIMIT 1""", "jobs")
def flt15(t):
    now = _now(EVENTS_AT)
    j = X.jobs(t).withColumn("next_retry_at", F.col("updated_at") + F.make_interval(mins=backoff_minutes(F.col("retry_count"))))
    ready = j.where((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("next_retry_at") <= now))).withColumn("prio", F.lit(1))
    stale = j.where((F.col("status") == "processing") & (F.col("updated_at") < now - F.expr("interval 30 minutes"))).withColumn("prio", F.lit(2))
    return ready.unionByName(stale).orderBy("prio", "created_at", "job_id").limit(1).select("job_id", "prio")


def backoff_minutes(n):
    return F.least(F.pow(F.lit(2), n), F.lit(30)).cast("int")


@query("flt16_retryable", "SELECT job_id, retry_count, last_error, least(power(2, retry_count), 30)::INT AS backoff_min FROM jobs WHERE status = 'failed' AND retry_count < 3 AND regexp_matches(last_error, 'temporary|timeout|network')", "jobs")
def flt16(t):
    return X.jobs(t).where((F.col("status") == "failed") & (F.col("retry_count") < 3) & F.col("last_error").rlike("temporary|timeout|network")).select("job_id", "retry_count", "last_error", backoff_minutes(F.col("retry_count")).alias("backoff_min"))


@query("j19_orphaned_documents", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j19(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("d10_card_operations", """SELECT card_id, CASE WHEN deck_id = 'Brand#12' AND status = 'draft' THEN 'active' ELSE status END AS status, array_to_string(list_sort(list_distinct(list_concat(tags, ['new']))), ',') AS tags FROM cards WHERE NOT (deck_id = 'Brand#13' AND status = 'suspended')""", "cards")
def d10(t):
    c = X.cards(t).where(~((F.col("deck_id") == "Brand#13") & (F.col("status") == "suspended")))
    approve = (F.col("deck_id") == "Brand#12") & (F.col("status") == "draft")
    return c.select("card_id", F.when(approve, "active").otherwise(F.col("status")).alias("status"), F.array_join(F.array_sort(F.array_union("tags", F.array(F.lit("new")))), ",").alias("tags"))


@query("d12_clear_jobs", "SELECT status, count(*) AS n FROM jobs WHERE status NOT IN ('failed', 'completed') GROUP BY status", "jobs")
def d12(t):
    return X.jobs(t).where(~F.col("status").isin("failed", "completed")).groupBy("status").agg(F.count("*").alias("n"))


@query("d7_ecs_latest", "SELECT user_id AS entity_id, event_type AS component_type, max(ts) AS updated_at, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2 HAVING arg_max(event_id, (ts, event_id)) % 5 <> 0")
def d7(t):
    """Append-only writes folded: the last of each (entity, component) counts; every fifth event is a removal."""
    at = F.struct("ts", "event_id")
    g = t.events.groupBy(F.col("user_id").alias("entity_id"), F.col("event_type").alias("component_type")).agg(F.max("ts").alias("updated_at"), F.max_by("value", at).alias("value"), F.max_by("event_id", at).alias("e"))
    return g.where("e % 5 <> 0").drop("e")


_U = "SELECT o_custkey AS user_id, count(*) % 5 AS a, (sum(o_orderkey) % 7)::DOUBLE AS b, count(*) % 3 AS c, CASE WHEN count(*) % 2 = 0 THEN 'softmax' END AS method FROM orders GROUP BY 1"


@query("d8_preferences", f"""WITH u AS (SELECT user_id, a::DOUBLE AS a, b, c::DOUBLE AS c, method, a + b + c AS s FROM ({_U}) WHERE user_id % 2 = 0),
  f AS (SELECT user_id, method, CASE WHEN s = 0 THEN 0.333 WHEN abs(s - 1) > 0.01 THEN round(a / s, 3) ELSE a END AS a, CASE WHEN s = 0 THEN 0.333 WHEN abs(s - 1) > 0.01 THEN round(b / s, 3) ELSE b END AS b, CASE WHEN s = 0 THEN 0.333 WHEN abs(s - 1) > 0.01 THEN round(c / s, 3) ELSE c END AS c FROM u)
  SELECT c_custkey AS user_id, coalesce(f.a, CASE WHEN c_custkey % 3 = 0 THEN 0.5 END, 0.333)::DOUBLE AS semantic_similarity, coalesce(f.b, CASE WHEN c_custkey % 3 = 0 THEN 0.25 END, 0.333)::DOUBLE AS contradiction_detection, coalesce(f.c, CASE WHEN c_custkey % 3 = 0 THEN 0.25 END, 0.333)::DOUBLE AS thematic_bridge,
    coalesce(f.method, CASE WHEN c_custkey % 3 = 0 THEN 'sigmoid' END, 'linear') AS method, CASE WHEN f.user_id IS NOT NULL AND c_custkey % 3 = 0 THEN 'updated' WHEN f.user_id IS NOT NULL THEN 'inserted' WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'default' END AS origin
  FROM customer LEFT JOIN f ON f.user_id = c_custkey""")
def d8(t):
    """Every third user has preferences, every second one with orders sends new weights."""
    engines = ["semantic_similarity", "contradiction_detection", "thematic_bridge"]
    n = F.count("*")
    u = t.orders.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("user_id")).agg((n % 5).alias(engines[0]), (F.sum("o_orderkey") % 7).alias(engines[1]), (n % 3).alias(engines[2]), F.when(n % 2 == 0, "softmax").alias("method"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    kept = users.where("user_id % 3 = 0").select("user_id", F.lit(0.5).alias(engines[0]), F.lit(0.25).alias(engines[1]), F.lit(0.25).alias(engines[2]), F.lit("sigmoid").alias("method"))
    return upsert_weights(users, kept, u, engines)


@query("d9_prompt_usage", "SELECT user_id, event_type, count(*) AS used, max(ts) AS last_used, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1 AS is_default FROM events GROUP BY user_id, event_type")
def d9(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("used"), F.max("ts").alias("last_used"))
    return g.withColumn("is_default", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("used"), "event_type")) == 1)


@query("flt19_review_queue", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '1995-06-08' ORDER BY l_discount DESC")
def flt19(t):
    return t.lineitem.where("l_returnflag = 'N' and l_shipdate >= timestamp'1995-06-01' and l_shipdate < timestamp'1995-06-08'").orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_discount")


@query("d14_import_review", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'pending' END AS status, k AS component_type,
  CASE WHEN k = 'Position' THEN (o_orderkey % 1000)::INT END AS start_offset, CASE k WHEN 'Visual' THEN o_orderpriority WHEN 'Content' THEN o_orderstatus END AS value
  FROM orders LEFT JOIN (SELECT unnest(['Position', 'Visual', 'Content', 'Temporal']) AS k) ON o_orderstatus = 'F' AND (k <> 'Content' OR o_orderkey % 5 <> 0)""")
def d14(t):
    """Candidates from orders, decided by the order's state; states with the components that acceptance makes."""
    key, s = F.col("o_orderkey"), F.col("o_orderstatus")
    start = (key % 1000).cast("int")
    c = t.orders.select(key.alias("id"), F.col("o_custkey").alias("document_id"), start.alias("start_offset"), (start + 50).alias("end_offset"), F.col("o_orderpriority").alias("color"), F.when(key % 5 != 0, s).alias("note"))
    states, rows = import_review(c, t.orders.where("o_orderstatus in ('F', 'P')").select(key.alias("id"), (s == "F").alias("accept")), _now("2024-01-15"))
    return states.join(rows.withColumnRenamed("entity_id", "id"), "id", "left").select("id", "status", "component_type", "start_offset", "value")


@query("time_distance", "SELECT event_id, abs(date_diff('hour', TIMESTAMP '2024-01-15', date_trunc('hour', ts))) AS hours, abs(date_diff('day', DATE '2024-01-15', ts::DATE)) AS days FROM events")
def time_distance(t):
    at = _now("2024-01-15")
    return t.events.select("event_id", F.abs(F.expr("timestampdiff(HOUR, timestamp'2024-01-15', date_trunc('hour', ts))")).alias("hours"), F.abs(F.datediff("ts", at)).cast("long").alias("days"))


@query("time_parse", "SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('day', ts) AS us FROM events")
def time_parse(t):
    e = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("a"), F.date_format("ts", "MM/dd/yyyy").alias("b"))
    return e.select("event_id", T.parse_time(F.col("a")).alias("iso"), T.parse_time(F.col("b")).alias("us"))
