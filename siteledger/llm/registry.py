"""Registered queries of this subpackage: key, callable and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(documents)`` under ``key``."""

    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        if sql is not None:
            SQL[key] = sql
        return fn

    return wrap
