"""Payloads of components: JSON of any shape as variants, typed extraction, and containment of array elements by a table of elements.

A payload is text. What parses becomes a variant; what does not is kept as it is, apart. A path is extracted with a type; a payload without it, or with
something else there, has null. `build` reads and parses the payloads once and writes one row for each element of the arrays at a path, in the order of
elements, so that a search for elements reads the row groups that hold them and no payload at all:

    payloads/   id, payload, malformed (null: no payload), array (at the path)          elements/   element, id, at (distinct elements of a row)

`contains` answers `payload -> path @> [a, b, ...]` for many searches at once: elements are joined, and a row that has as many of them as a search has distinct
values holds all. Searches without values find nothing; null elements are never found; rows that repeat an id are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def variant(payload: Column) -> Column:
    """The payload as a variant; null if it is null or malformed."""
    return F.try_parse_json(payload)


def extract(payload: Column, path: str, kind: str) -> Column:
    """What stands at a path ($.a.b[0]) as a type, null if it is not there or is of another kind."""
    return F.try_variant_get(payload, path, kind)


def contains_object(payload: Column, wanted: dict, path: str = "$") -> Column:
    """Whether a variant holds an object's members, at any depth: numbers, texts and booleans equal, null as null, objects within objects, lists as subsets."""
    out = F.lit(True)
    for name, value in wanted.items():
        at = f"{path}.{name}"
        if isinstance(value, dict):
            found = F.try_variant_get(payload, at, "variant").isNotNull() & contains_object(payload, value, at)
        elif isinstance(value, list):
            own = F.try_variant_get(payload, at, "array<string>")
            found = own.isNotNull() & (F.size(F.array_except(F.array(*(F.lit(text_of(v)) for v in value)) if value else F.array().cast("array<string>"), own)) == 0)
        elif value is None:
            found = F.is_variant_null(F.try_variant_get(payload, at, "variant"))
        elif isinstance(value, bool):
            found = F.try_variant_get(payload, at, "boolean") == F.lit(value)
        elif isinstance(value, int | float):
            found = F.try_variant_get(payload, at, "double") == F.lit(float(value))
        else:
            found = F.try_variant_get(payload, at, "string") == F.lit(value)
        out = out & F.coalesce(found, F.lit(False))
    return out & payload.isNotNull()


def text_of(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


class PayloadTable:
    """A written table of payloads with its elements."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        every, self.elements = (spark.read.parquet(f"{folder}/{n}") for n in ("payloads", "elements"))
        self.rows, self.malformed = (every.where(x).select("id", "payload") for x in ("not malformed", "malformed"))

    @staticmethod
    def build(payloads: DataFrame, path: str, kind: str, folder: str) -> PayloadTable:
        """payloads (id, payload); kind: the type of the elements of the arrays at path."""
        spark = payloads.sparkSession
        v = variant(F.col("payload"))
        malformed = F.when(F.col("payload").isNotNull(), v.isNull())  # a condition on the payload would work it out twice; null payloads are neither
        payloads.select("id", "payload", malformed.alias("malformed"), extract(v, path, f"array<{kind}>").alias("array")).write.parquet(f"{folder}/payloads")
        each = spark.read.parquet(f"{folder}/payloads").select("id", F.posexplode("array").alias("at", "element")).where("element is not null")
        # Dealt out once, before they are grouped: the groups of a row's equal elements lie within a range.
        each = each.repartitionByRange("element", "id").groupBy("element", "id").agg(F.min("at").alias("at"))
        each.select("element", "id", "at").sortWithinPartitions("element", "id").write.parquet(f"{folder}/elements")
        return PayloadTable(spark, folder)

    def holding(self, *values) -> DataFrame:
        """ids of rows whose array holds all the values; reads their elements only."""
        wanted = sorted({v for v in values if v is not None})
        found = self.elements.where(F.col("element").isin(wanted)).groupBy("id").agg(F.count("*").alias("n"))
        return found.where(F.col("n") == len(wanted)).select("id") if wanted and None not in values else found.where(F.lit(False)).select("id")

    def contains(self, searches: DataFrame) -> DataFrame:
        """searches (search, values: array) to search, id: the rows that hold all values of each."""
        s = searches.where(~F.exists("values", lambda v: v.isNull())).select("search", F.array_distinct("values").alias("values"))
        asked = s.select("search", F.size("values").alias("need"), F.explode("values").alias("element"))
        met = asked.join(self.elements.select("element", "id"), "element").groupBy("search", "id").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        return met.where("n = need").select("search", "id")
