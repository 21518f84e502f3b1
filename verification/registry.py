"""Query registry: key, Spark callable and the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteledger.session import COMPRESSION, COMPRESSION_KEY

from .views import frame, sql_prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COMMON: dict[str, str] = {}

#: Settings that the queries need in whatever session they are given.
SESSION = {"spark.sql.session.timeZone": "UTC", COMPRESSION_KEY: COMPRESSION}


class Tables:
    """Attribute access to tables and views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def spread(self, df: DataFrame) -> DataFrame:
        """A supplied table is one small file, so few tasks; deal costly rows to every core, on a cluster too."""
        return df.repartition(4 * self.spark.sparkContext.defaultParallelism)


def query(key: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``key`` with its SQL check."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for setting, value in SESSION.items():
                spark.conf.set(setting, value)
            return fn(Tables(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn

    return wrap


def common(name: str, sql: str) -> None:
    """A named SQL step that several checks share (never used on the Spark side)."""
    COMMON[name] = sql


def oracle() -> dict[str, str]:
    return {key: sql_prelude(text, COMMON) for key, text in SQL.items()}


def r(expression: str, digits: int) -> str:
    """SQL for half-up rounding after dropping noise beyond eight decimals."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"
