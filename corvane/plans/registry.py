"""Where queries and their oracles are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.tables import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its oracle where SQL can express it."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if oracle is not None:
            _ORACLES[function.__name__] = oracle
        return function

    return add


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A query over the folder's tables, named in braces; no view is left behind."""
    used = {name: table(spark, folder, name) for name in TABLES if f"{{{name}}}" in text}
    return spark.sql(text, **used)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def dialect(name: str, text: str, oracle: str | None, *tables: str) -> None:
    """Register a query written in the dialect's own SQL over the folder's tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        from corvane.functions.types import family
        from corvane.operators.dml import Table

        from .database import Database

        database = Database(spark)
        for t in tables:
            rows = table(spark, folder, t)
            kinds = {f.name: {"integer": "bigint", "double": "double precision"}.get(family(f.dataType), family(f.dataType)) for f in rows.schema}
            database.tables["public", t] = Table(t, kinds, rows)
        return database.sql(text)

    run.__name__ = name
    _QUERIES[name] = run
    if oracle is not None:
        _ORACLES[name] = oracle
