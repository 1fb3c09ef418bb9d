"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import bpe, conversation_repair, exact_topk, language_id, line_dedup, minhash_dedup, mixing, packing, prefix_trie, sharding, suffix_dedup, toxicity, vector_dedup
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(crc_mod("doc_id", 5) != 0))
    return language_id.predict(spark, docs, model, "text", F.col("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, _table(spark, sf_dir, "documents"), count_col="lines_dropped")
    return out.select("doc_id", "lines_dropped", F.length("text").alias("chars_kept"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), most=2048)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark, _table(spark, sf_dir, "embeddings"), threshold=0.93)


#: Small enough that tables of a few MB split several times, some buckets deeper than others; a parameter of the operator.
SHARD_BYTES = 160 << 10


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(spark, _table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"), k=4, threshold=0.8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model, limits = toxicity.train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    out = toxicity.score(spark, docs, model, "text", F.col("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("lang"))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.coalesce("lang", F.lit(""))] if limits else F.lit(None)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), (F.col("score") >= F.coalesce(limit.cast("double"), F.lit(0.5))).cast("int").alias("by_language"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(spark, _table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return prefix_trie.trie(spark, prefix_trie.rebuilt(prefix_trie.conversations(turns)))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM s),
k AS (SELECT *, row_number() OVER f AS k,
        ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(lim) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW f AS (ORDER BY lim / w, source NULLS LAST)),
l AS (SELECT arg_min(level, k) AS level FROM k WHERE lim > level * w),
t AS (SELECT source, source_size, coalesce(least(lim, (SELECT level FROM l) * w), lim) AS target,
        ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM k),
r AS (SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(rate * rank + start) - floor(rate * (rank - 1) + start), 2))::BIGINT AS taken FROM r
"""


OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, l.depth, h >> (60 - l.depth)::INT AS shard FROM d, (SELECT unnest(range(0, 41)) AS depth) l),
s AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM p GROUP BY depth, shard
      HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h)),
j AS (SELECT doc_id, n_bytes, p.depth, p.shard, shard_docs, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) AS k
      FROM p JOIN s ON p.depth = s.depth AND p.shard = s.shard)
SELECT doc_id, n_bytes, depth, shard, shard_docs, shard_bytes, shard_bytes <= {SHARD_BYTES} AS fits FROM j WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": OP5, "op6_mixing": OP6}
