"""Daily fact merges, keyword snapshots and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from .ranking import newest_per_key, top_per_key

STRIKING_MIN, STRIKING_MAX = 4, 20
STORED_KEYWORDS = 25
STORED_QUERIES = 10


def merge_search_days(rows: DataFrame) -> DataFrame:
    """One row per (page, date): sums, impression-weighted position, CTR from the sums."""
    return (
        rows.groupBy("site_id", "page_id", "date")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.sum(F.col("position") * F.col("impressions")).alias("_w"),
        )
        .withColumns(
            {
                "ctr": F.when(F.col("impressions") != 0, rnd(F.col("clicks") / F.col("impressions"), 6)).otherwise(0.0),
                "position": F.when(F.col("impressions") != 0, rnd(F.col("_w") / F.col("impressions"), 2)),
            }
        )
        .drop("_w")
    )


def merge_activity_days(rows: DataFrame) -> DataFrame:
    """One row per (page, date): sums, session-weighted rates, revenue = purchase value, else total."""
    s = F.sum("sessions")

    def per_session(total, digits: int):
        return F.when(s != 0, rnd(total / s, digits)).otherwise(F.lit(0.0))

    revenue = F.when(F.col("purchase_revenue") != 0, F.col("purchase_revenue")).otherwise(F.col("total_revenue"))
    return rows.groupBy("site_id", "page_id", "date").agg(
        F.sum("users").cast("long").alias("users"),
        F.sum("new_users").cast("long").alias("new_users"),
        s.cast("long").alias("sessions"),
        F.sum("screen_page_views").cast("long").alias("screen_page_views"),
        F.sum("engaged_sessions").cast("long").alias("engaged_sessions"),
        per_session(F.sum(F.col("engagement_rate") * F.col("sessions")), 4).alias("engagement_rate"),
        per_session(F.sum(F.col("bounce_rate") * F.col("sessions")), 4).alias("bounce_rate"),
        per_session(F.sum("duration"), 2).alias("average_engagement_time"),
        rnd(F.sum("conversions"), 2).alias("conversions"),
        rnd(F.sum(revenue), 2).alias("revenue"),
    )


def keyword_summary(keywords: DataFrame, keys: list[str]) -> DataFrame:
    """Opportunity signals of each snapshot's keyword rows (long form, partial aggregation)."""
    p, v = F.col("position"), F.col("volume")
    striking = p.between(STRIKING_MIN, STRIKING_MAX)
    return keywords.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("organic_keywords"),
        F.count_if(striking).alias("striking_distance_keywords"),
        F.coalesce(F.sum(F.when(striking, v)), F.lit(0)).cast("long").alias("opportunity_volume"),
        F.min(F.when(p > 0, p)).alias("best_position"),
        rnd(F.avg(F.when(p > 0, p)), 1).alias("average_position"),
        rnd(F.sum(v * F.col("cpc")) / 100.0, 2).alias("organic_cost"),
    )


def top_keywords(keywords: DataFrame, keys: list[str], k: int = STORED_KEYWORDS) -> DataFrame:
    """The ``k`` largest keywords of each snapshot, by volume then position, as rows with their rank."""
    order = [F.col("volume").desc(), F.col("position").asc(), F.col("keyword").asc()]
    return top_per_key(keywords, keys, order, k, "keyword_rank")


def attach_queries(days: DataFrame, queries: DataFrame, *, start: str, end: str, k: int = STORED_QUERIES) -> DataFrame:
    """The top queries of each page, on the newest day row the page has in [start, end].

    Pages without a day row are dropped: no empty day is invented to hold the queries.
    """
    newest = (
        days.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        .groupBy("page_id")
        .agg(F.max("date").alias("date"))
    )
    order = [F.col("clicks").desc(), F.col("impressions").desc(), F.col("query").asc()]
    return top_per_key(queries, ["page_id"], order, k, "query_rank").join(newest, "page_id")


def striking_keywords(snapshots: DataFrame, pages: DataFrame, limit: int = 50) -> DataFrame:
    """Per site, the keywords at positions 4..20 with most volume, from each page's newest snapshot."""
    newest = newest_per_key(snapshots, ["page_id"], ["date", "snapshot_id"])
    rows = newest.select("page_id", F.explode("keywords").alias("k")).select("page_id", "k.*")
    hits = rows.filter(F.col("position").between(STRIKING_MIN, STRIKING_MAX)).join(
        pages.select("page_id", "site_id", "url"), "page_id"
    )
    order = [F.col("volume").desc(), F.col("position").asc(), F.col("page_id").asc(), F.col("keyword").asc()]
    return top_per_key(hits, ["site_id"], order, limit, "opportunity_rank")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], newest: list[str] | None = None) -> DataFrame:
    """Rows of ``updates`` replace rows of ``target`` with the same key; all other rows are kept.

    With ``newest`` the updates are first reduced to their newest row per key.
    """
    fresh = newest_per_key(updates, keys, newest) if newest else updates
    kept = target.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def upsert_nullsafe(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert where a null key equals a null key.

    Keys become a struct, which compares null fields as equal, so the anti join stays an equi join.
    """
    marks = updates.select(F.struct(*keys).alias("_k")).distinct()
    kept = target.withColumn("_k", F.struct(*keys)).join(marks, "_k", "left_anti").drop("_k")
    return kept.unionByName(updates.select(*target.columns))


def write_facts(df: DataFrame, path: str) -> None:
    """Replace exactly the dates present in ``df`` (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def prune(df: DataFrame, *, today: str, keep_days: int = 730) -> DataFrame:
    """Rows younger than the retention limit; on a date-partitioned table this prunes partitions."""
    return df.filter(F.col("date") >= F.date_sub(F.to_date(F.lit(today)), keep_days))
