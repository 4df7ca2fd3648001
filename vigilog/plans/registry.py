"""The registered queries and their SQL for DuckDB, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from vigilog.plans import aggregate_queries, function_queries, hot_queries, join_queries, model_queries, parse_queries, rule_queries, signature_queries, source_queries, stream_queries, window_queries  # noqa: F401


_loaded = False


def load() -> dict[str, Query]:
    global _loaded
    if not _loaded:
        _loaded = True
        _load()
    return QUERIES
