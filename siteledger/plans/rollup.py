"""Daily rollups and date-aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators.ranking import top_per_key

TRACKED_PAGES = 500
SEARCH = ("clicks", "impressions")
ACTIVITY = ("users", "sessions", "conversions", "revenue")


def site_rollup(pages: DataFrame, open_issues: DataFrame, gsc: DataFrame, ga4: DataFrame, *, day: str) -> DataFrame:
    """One history row per site for ``day``: counts, means, issues and the day's traffic."""
    on_day = F.col("date") == F.to_date(F.lit(day))
    base = pages.filter("is_active").groupBy("site_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        rnd(F.avg("seo_score"), 1).alias("seo_score"),
        rnd(F.avg("priority_score"), 1).alias("priority_score"),
    )
    issues = open_issues.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_count")
    )
    search = gsc.filter(on_day).groupBy("site_id").agg(*[F.sum(c).alias(c) for c in SEARCH])
    activity = ga4.filter(on_day).groupBy("site_id").agg(*[F.sum(c).alias(c) for c in ACTIVITY])
    out = base.join(issues, "site_id", "left").join(search, "site_id", "left").join(activity, "site_id", "left")
    return out.fillna(0, ["issue_count", "critical_count", *SEARCH, *ACTIVITY]).select(
        "site_id", F.lit(None).cast("long").alias("page_id"), F.to_date(F.lit(day)).alias("date"), F.lit("website").alias("scope"),
        "seo_score", "priority_score", "issue_count", "critical_count", "page_count", *SEARCH, *ACTIVITY,
    )


def page_rollup(pages: DataFrame, *, day: str, k: int = TRACKED_PAGES) -> DataFrame:
    """History rows of the ``k`` pages of each site with the highest priority."""
    scored = pages.filter("is_active and priority_score is not null")
    tracked = top_per_key(scored, ["site_id"], [F.col("priority_score").desc(), F.col("page_id").asc()], k)
    return tracked.select(
        "site_id", "page_id", F.to_date(F.lit(day)).alias("date"), F.lit("page").alias("scope"), "seo_score", "priority_score", "issue_count",
        F.when(F.col("highest_severity") == "CRITICAL", 1).otherwise(0).alias("critical_count"), F.lit(1).alias("page_count"),
    )


def daily_series(key: str, gsc: DataFrame, ga4: DataFrame, history: DataFrame, *, since: str) -> DataFrame:
    """Search, activity and history of every page (or site) on one date axis.

    The three sources are padded to one shape, united and aggregated once; a full outer join would
    shuffle each side twice.
    """
    recent = F.col("date") >= F.to_date(F.lit(since))
    scores = ("seo_score", "priority_score", "issue_count")
    every = (*SEARCH, *ACTIVITY, *scores)

    def pad(df: DataFrame, own: tuple[str, ...]) -> DataFrame:
        picks = [F.col(c).cast("double").alias(c) if c in own else F.lit(None).cast("double").alias(c) for c in every]
        return df.filter(recent).select(key, "date", *picks)

    rows = pad(gsc, SEARCH).unionByName(pad(ga4, ACTIVITY)).unionByName(pad(history, scores))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy(key, "date").agg(
        *[total(c).cast("long").alias(c) for c in ("clicks", "impressions", "users", "sessions")],
        *[rnd(total(c), 2).alias(c) for c in ("conversions", "revenue")],
        F.max("seo_score").alias("seo_score"),
        F.max("priority_score").alias("priority_score"),
        F.coalesce(F.max("issue_count"), F.lit(0.0)).cast("long").alias("issue_count"),
    )
