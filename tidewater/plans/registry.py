"""All registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    """Register a query under its function's name; ``ids`` are the operators of the survey that it covers."""

    def add(f):
        f.ids = ids
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import (  # noqa: F401
        annotation_queries,
        benchmark_queries,
        expression_queries,
        memory_queries,
        metric_queries,
        question_queries,
        retrieval_queries,
        sampling_queries,
        sequence_queries,
        source_queries,
        stream_queries,
        turn_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
