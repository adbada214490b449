"""Registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..database import Database

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(spark: SparkSession, folder: str) -> Database:
    return Database(spark, {t: f"{folder}/{t}.parquet" for t in TABLES})


def register(name: str, sql: str | None = None) -> Callable:
    """Of a function from Database to DataFrame or fluent query."""

    def keep(function: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            found = function(database(spark, folder))
            return found if isinstance(found, DataFrame) else found.get()

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return function

    return keep


def queries() -> dict[str, Query]:
    from . import changes, relational, scalars, surface  # noqa: F401  registers

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
