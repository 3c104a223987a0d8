"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.graph import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def simple(name: str, source: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query of one table."""
    QUERIES[name] = lambda spark, d: make(table(spark, d, source))
    ORACLE_SQL[name] = sql
