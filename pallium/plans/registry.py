"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the given tables;
its oracle is an SQL string over the same tables registered as views. Both
return flat columns with identical names (maps and arrays become rows or
strings; counts are bigint on both sides).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
NOTES: dict[str, str] = {}


def query(name: str, sql: str | None = None, note: str = ""):
    """Register ``fn`` under ``name`` with optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if note:
            NOTES[name] = note
        return fn

    return deco
