"""Lookback aggregation over daily facts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from .ranking import newest_per_key

METRIC_COLUMNS = (
    "users",
    "sessions",
    "engagement_rate",
    "average_engagement_time",
    "conversions",
    "revenue",
    "clicks",
    "impressions",
    "ctr",
    "position",
    "organic_keywords",
    "organic_traffic",
    "striking_distance_keywords",
    "opportunity_volume",
    "backlinks",
)


def window_filter(today: str, days: int, until: str | None = None) -> Column:
    """Dates in [today - days, until). The lower bound is inclusive, the upper bound optional."""
    keep = F.col("date") >= F.date_sub(F.to_date(F.lit(today)), days)
    return keep if until is None else keep & (F.col("date") < F.to_date(F.lit(until)))


def search_totals(gsc: DataFrame) -> DataFrame:
    """Per page: summed clicks and impressions, unweighted mean position, CTR from the totals."""
    return (
        gsc.groupBy("page_id")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            rnd(F.avg("position"), 1).alias("position"),
        )
        .withColumn("ctr", F.when(F.col("impressions") > 0, rnd(F.col("clicks") / F.col("impressions"), 4)))
    )


def activity_totals(ga4: DataFrame) -> DataFrame:
    """Per page: summed activity, unweighted daily means of engagement rate and time."""
    return ga4.groupBy("page_id").agg(
        F.sum("users").alias("users"),
        F.sum("sessions").alias("sessions"),
        F.avg("engagement_rate").alias("engagement_rate"),
        F.avg("average_engagement_time").alias("average_engagement_time"),
        F.sum("conversions").alias("conversions"),
        F.sum("revenue").alias("revenue"),
    )


def newest_snapshot(semrush: DataFrame) -> DataFrame:
    """The newest snapshot row of every page (ties broken by the larger snapshot id)."""
    return newest_per_key(semrush, ["page_id"], ["date", "snapshot_id"])


def page_metrics(
    pages: DataFrame,
    gsc: DataFrame,
    ga4: DataFrame,
    semrush: DataFrame,
    *,
    today: str,
    window_days: int = 90,
    until: str | None = None,
) -> DataFrame:
    """Every page with its window metrics; counts default to zero, rates to null.

    The snapshot source ignores ``until``: only its newest row in the window counts.
    """
    snapshot_columns = [
        "organic_keywords",
        "organic_traffic",
        "striking_distance_keywords",
        "opportunity_volume",
        "backlinks",
    ]
    keep = window_filter(today, window_days, until)
    search = search_totals(gsc.filter(keep).select("page_id", "date", "clicks", "impressions", "position"))
    activity = activity_totals(ga4.filter(keep))
    snapshot = newest_snapshot(
        semrush.filter(window_filter(today, window_days)).select("page_id", "date", "snapshot_id", *snapshot_columns)
    ).drop("date", "snapshot_id")
    joined = pages.join(activity, "page_id", "left").join(search, "page_id", "left").join(snapshot, "page_id", "left")
    zero = {c: 0 for c in ("users", "sessions", "clicks", "impressions", *snapshot_columns)}
    return joined.fillna({**zero, "conversions": 0.0, "revenue": 0.0})


def available_sources(gsc: DataFrame, ga4: DataFrame, semrush: DataFrame) -> DataFrame:
    """Per site, which sources hold any row. Each side is distinct before the union."""
    flagged = [
        df.select("site_id").distinct().withColumn("source", F.lit(name))
        for name, df in (("gsc", gsc), ("ga4", ga4), ("semrush", semrush))
    ]
    rows = flagged[0].unionByName(flagged[1]).unionByName(flagged[2])
    return rows.groupBy("site_id").agg(
        *[F.max(F.col("source") == s).alias(f"has_{s}") for s in ("gsc", "ga4", "semrush")]
    )
