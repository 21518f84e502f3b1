"""Priority matrix, site overview and weekly roadmap for all sites in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import BANDS, lookup, num, rnd
from ..operators.ranking import top_per_key
from ..operators.settings import overlay

# Matrix weights, severity points, overview bands, weeks (number, label, levels, size).
MATRIX_WEIGHTS = {
    "seo_opportunity": 0.25,
    "user_activity_opportunity": 0.20,
    "business_value": 0.20,
    "technical_severity": 0.20,
    "keyword_opportunity": 0.15,
}
SEVERITY_POINTS = {"CRITICAL": 100.0, "HIGH": 70.0, "MEDIUM": 40.0, "LOW": 15.0, "NONE": 0.0}
WEEKS = (
    (1, "Highest-impact fixes", ("P0", "P1"), 10),
    (2, "Supporting optimisation and keyword coverage", ("P2",), 20),
    (3, "Technical cleanup and polish", ("P3",), 30),
)
SCHEDULED = ("detected", "approved")


def level_rank(level: Column | str) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return lookup(F.coalesce(c, F.lit("P3")), {b: i for i, b in enumerate(BANDS)}, 3)


def best_recommendations(scores: DataFrame) -> DataFrame:
    """Per page: best search, activity and business score, the top row, the most urgent level."""
    top = F.struct(num("overall_priority").alias("s"), (-F.col("score_id")).alias("t"))
    return scores.groupBy("page_id").agg(
        F.max("search_impact_score").alias("best_search"),
        F.max("user_activity_score").alias("best_activity"),
        F.max("business_impact_score").alias("best_business"),
        F.max_by("recommendation_type", top).alias("top_type"),
        F.max_by("reason", top).alias("top_reason"),
        F.min(level_rank("priority_level")).alias("_level"),
    ).withColumn("level", lookup(F.col("_level"), dict(enumerate(BANDS)), "P3")).drop("_level")


def matrix_weights(sites: DataFrame, settings: DataFrame) -> DataFrame:
    raw = overlay(sites, settings, "matrix_weights", MATRIX_WEIGHTS, floor_zero=False)
    total = sum((F.col(c) for c in MATRIX_WEIGHTS), F.lit(0.0))
    divisor = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return raw.select("site_id", *[(F.col(c) / divisor).alias(c) for c in MATRIX_WEIGHTS])


def priority_matrix(pages: DataFrame, scores: DataFrame, profiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row per active page: five opportunity figures, blended priority and level."""
    keywords = profiles.select("page_id", F.col("keyword_opportunity_score").alias("_kw"))
    rows = pages.filter("is_active").join(best_recommendations(scores), "page_id", "left").join(keywords, "page_id", "left")
    parts = {
        "seo_opportunity": num("best_search"),
        "user_activity_opportunity": num("best_activity"),
        "business_value": num("best_business"),
        "technical_severity": lookup(F.upper(F.coalesce("highest_severity", F.lit("NONE"))), SEVERITY_POINTS, 0.0),
        "keyword_opportunity": num("_kw"),
    }
    if weights is None:
        w = {c: F.lit(v) for c, v in MATRIX_WEIGHTS.items()}
    else:
        rows = rows.join(weights.select("site_id", *[F.col(c).alias(f"_w_{c}") for c in MATRIX_WEIGHTS]), "site_id", "left")
        w = {c: F.coalesce(F.col(f"_w_{c}"), F.lit(v)) for c, v in MATRIX_WEIGHTS.items()}
    overall = sum((w[c] * parts[c] for c in parts), F.lit(0.0))
    band = F.when(overall >= 70, "P0").when(overall >= 50, "P1").when(overall >= 30, "P2").otherwise("P3")
    return rows.select(
        "site_id",
        "page_id",
        "url",
        "path",
        *[rnd(v, 1).alias(c) for c, v in parts.items()],
        rnd(overall, 1).alias("overall_priority"),
        F.coalesce("level", band).alias("priority_level"),
        F.col("top_type").alias("top_recommendation"),
        F.col("top_reason").alias("top_recommendation_reason"),
    )


def opportunity_band(score: Column) -> Column:
    return F.when(score >= 65, "HIGH").when(score >= 35, "MEDIUM").otherwise("LOW")


def site_overview(matrix: DataFrame) -> DataFrame:
    """Per site: mean priority, growth and activity bands, pages per level."""
    return matrix.groupBy("site_id").agg(
        rnd(F.avg("overall_priority"), 1).alias("overall_seo_opportunity"),
        opportunity_band(rnd(F.avg("seo_opportunity"), 6)).alias("organic_growth_opportunity"),
        opportunity_band(rnd(F.avg("user_activity_opportunity"), 6)).alias("user_activity_opportunity"),
        *[F.count_if(F.col("priority_level") == b).alias(f"{b.lower()}_pages") for b in BANDS],
    )


def _week(level: Column) -> Column:
    return lookup(level, {lv: number for number, _, levels, _ in WEEKS for lv in levels}, 3)


def roadmap_weeks(scores: DataFrame, pages: DataFrame, matrix: DataFrame) -> DataFrame:
    """Scheduled rows of every site: by week, most urgent level first, then score, up to the week's size.

    Sites without an open recommendation fall back to their matrix rows. The sizes bound each week, so
    rows are pruned before the shuffle.
    """
    open_rows = (
        scores.filter(F.col("status").isin(*SCHEDULED))
        .join(pages.select("page_id", "url"), "page_id")
        .select(
            "site_id", "page_id", "url", F.col("score_id").alias("item_id"), "recommendation_type", "priority_level", "overall_priority",
            "search_impact_score", "user_activity_score", "effort", "reason", F.lit("recommendation").alias("source"),
        )
    )
    scheduled = open_rows.select("site_id").distinct()
    fallback = (
        matrix.filter("top_recommendation is not null")
        .join(scheduled, "site_id", "left_anti")
        .select(
            "site_id", "page_id", "url", F.col("page_id").alias("item_id"), F.lit("technical_issue").alias("recommendation_type"), "priority_level",
            "overall_priority", F.col("seo_opportunity").alias("search_impact_score"), F.col("user_activity_opportunity").alias("user_activity_score"),
            F.lit("medium").alias("effort"), F.col("top_recommendation_reason").alias("reason"), F.lit("matrix").alias("source"),
        )
    )
    rows = open_rows.unionByName(fallback).withColumn("week", _week(F.coalesce("priority_level", F.lit("P3"))))
    order = [level_rank("priority_level").asc(), num("overall_priority").desc(), F.col("item_id").asc()]
    largest = max(size for *_, size in WEEKS)
    placed = top_per_key(rows, ["site_id", "week"], order, largest, "position")
    sizes = {number: size for number, _, _, size in WEEKS}
    return placed.filter(F.col("position") <= lookup(F.col("week"), sizes, largest))


def level_counts(scores: DataFrame, matrix: DataFrame) -> DataFrame:
    """Open items per level and site, from recommendations, else from the matrix."""
    open_rows = scores.filter(F.col("status").isin(*SCHEDULED)).select("site_id", "priority_level")
    rest = matrix.filter("top_recommendation is not null").join(open_rows.select("site_id").distinct(), "site_id", "left_anti")
    rows = open_rows.unionByName(rest.select("site_id", "priority_level"))
    at = lambda b: F.count_if(F.coalesce("priority_level", F.lit("P3")) == b)
    names = ("critical_issue_count", "high_impact_count", "medium_impact_count", "low_impact_count")
    return rows.groupBy("site_id").agg(*[at(b).alias(n) for b, n in zip(BANDS, names)])


def roadmap(scores: DataFrame, pages: DataFrame, matrix: DataFrame, *, generated_on: str) -> DataFrame:
    """One snapshot row per site; its weeks hold at most 60 items."""
    item = F.struct(
        "week", "position", "item_id", "page_id", "url", "recommendation_type", "priority_level", "overall_priority", "search_impact_score",
        "user_activity_score", "effort", "reason", "source",
    )
    weeks = roadmap_weeks(scores, pages, matrix).groupBy("site_id").agg(F.array_sort(F.collect_list(item)).alias("weeks"))
    return (
        site_overview(matrix)
        .join(level_counts(scores, matrix), "site_id", "left")
        .join(weeks, "site_id", "left")
        .withColumn("generated_on", F.to_date(F.lit(generated_on)))
    )
