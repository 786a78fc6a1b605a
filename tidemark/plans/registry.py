"""Queries of the engine's own operators by name, with DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` may name the shared CTEs of ``inputs``."""

    def add(f: Query) -> Query:
        from tidemark.plans.inputs import with_inputs

        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_inputs(sql)
        return f

    return add
