"""Names of queries, what computes them and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Named sub-queries that SQL texts may ask for: the same adapters as in fixtures.py.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


class Tables:
    """The tables below a folder, by name, and the shapes derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _gather(names: tuple[str, ...], into: dict[str, str]) -> None:
    for n in names:
        needs, text = PARTS[n]
        _gather(needs, into)
        into.setdefault(n, text)


def query(name: str, sql: str | None = None, parts: str = ""):
    """Register a function of Tables; sql may use the parts named."""

    def put(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return f(Tables(spark, folder))

        run.__name__, run.__doc__ = name, f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            got: dict[str, str] = {}
            _gather(tuple(parts.split()), got)
            head = ", ".join(f"{k} AS ({v})" for k, v in got.items())
            body = sql.strip()
            if head and body.upper().startswith("WITH "):
                SQL[name] = f"WITH {head}, {body[5:]}"
            else:
                SQL[name] = f"WITH {head} {body}" if head else body
        return f

    return put
