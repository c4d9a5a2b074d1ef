"""Registered queries: each has a Spark function of (spark, sf_dir) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import answers, checks, graphs, models, samples, texts, vectors  # noqa: F401  they register themselves

    return QUERIES, SQL
