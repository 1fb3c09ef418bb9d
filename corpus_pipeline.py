"""A corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and returns what the next one takes; run() writes each
result as Parquet under the shared folder and reads it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from skein.llm.common import Scratch
from skein.shipping import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter have no language and go; lang becomes the one predicted from the text.

    Null, empty and letterless texts go, and no others, whatever languages are called; repeated rows, null ids and languages, very long texts and columns of any other name stay. Ties: the
    smaller language. Without any language in the table nothing can be predicted: every document with a letter stays as it is.
    """
    ship_package(spark)
    model = language_id.train(docs)
    names = docs.columns
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = language_id.predict(spark, docs, model, "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), unknown=None)
    out = out.where("lang_pred is not null")
    return out.select(*[(F.col("lang_pred") if c == "lang" else F.col("row").getField(c)).alias(c) for c in names])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for their first place; a document that loses all its lines was a copy and goes with them.

    Null and blank texts have no lines and stay. Rows that repeat a document stay alike. n_chars follows the text; all other columns, whatever
    their names, stay. Order of documents: id (nulls first), then the text's hash, so there are no ties.
    """
    ship_package(spark)
    names, count = docs.columns, "_dropped"
    while count in {c.lower() for c in names}:
        count += "_"
    out = line_dedup.dedup_lines(spark, docs, count_col=count)
    out = out.where((F.col(count) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id: five-word shingles, similarity of 0.8 or more.

    Null, empty and wordless texts, and null ids, are linked with nothing and stay, as do the rows that repeat the id that stays.
    """
    ship_package(spark)
    return minhash_dedup.one_per_group(spark, docs, k=5, threshold=0.8).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times.

    Null texts count 0 words; a null source is a source of its own, the last. Ties in size go by id. Rows that repeat a document share its copies.
    """
    return mixing.mixed_documents(spark, docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the single id 0. Repeated rows are packed each. Other columns are not read.
    """
    import public_tokenizers

    ship_package(spark)
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), most=2048)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer and no trained language profiles: tests/llm compares run() with brute force stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tmp.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
