"""Registered queries: name -> Spark callable ``(spark, sf_dir) -> DataFrame`` and, where
SQL can express it, the DuckDB oracle text.  ``__spark_entry__`` exposes both.

Every query reads the driver tables (through the fixture views) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from meterwise.plans import queries_control, queries_metering, queries_reads, queries_rules, queries_tier_a, queries_tier_b  # noqa: F401
