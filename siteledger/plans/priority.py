"""Page priority: which page of which site to fix first, for all sites in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.priority import (
    DEFAULT_WEIGHTS,
    ga4_activity_raw,
    gsc_search_raw,
    normalised_weights,
    redistributed_weights,
    semrush_opportunity_raw,
    seo_severity_raw,
)
from ..operators.ranking import PART, percent_ranks, row_numbers
from ..operators.settings import overlay
from ..session import cut

COMPONENTS = tuple(DEFAULT_WEIGHTS)

# Band shares of a site's distribution, absolute cut-offs for small sites.
BAND_SHARES = {"P0": 0.05, "P1": 0.20, "P2": 0.50}
ABSOLUTE_BANDS = {"P0": 70.0, "P1": 50.0, "P2": 30.0}
SMALL_SITE = 8

BREAKDOWN_METRICS = (
    "users",
    "sessions",
    "conversions",
    "revenue",
    "clicks",
    "impressions",
    "ctr",
    "position",
    "organic_keywords",
    "striking_distance_keywords",
)


def raw_components(pages_with_metrics: DataFrame) -> DataFrame:
    """(site_id, page_id) and the four raw component columns."""
    return pages_with_metrics.select(
        "site_id",
        "page_id",
        seo_severity_raw("highest_severity", "seo_score", "issue_count").alias("seo_severity_raw"),
        ga4_activity_raw().alias("ga4_activity_raw"),
        gsc_search_raw().alias("gsc_search_raw"),
        semrush_opportunity_raw().alias("semrush_opportunity_raw"),
    )


def site_weights(sites: DataFrame, settings: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Configured weights per site (normalised), redistributed over available sources when given."""
    configured = overlay(sites, settings, "priority_weights", DEFAULT_WEIGHTS)
    normal = normalised_weights({c: F.col(c) for c in COMPONENTS}, DEFAULT_WEIGHTS)
    out = configured.select("site_id", *[w.alias(c) for c, w in normal.items()])
    if sources is None:
        return out
    return share_weights(out, sources)


def share_weights(weights: DataFrame, sources: DataFrame) -> DataFrame:
    """Redistribute each site's weights over the sources it has."""
    available = {"seo": F.lit(True)} | {
        s: F.coalesce(F.col(f"has_{s}"), F.lit(False)) for s in ("gsc", "ga4", "semrush")
    }
    shared = redistributed_weights({c: F.col(c) for c in COMPONENTS}, available)
    return weights.join(sources, "site_id", "left").select("site_id", *[w.alias(c) for c, w in shared.items()])


def _band(score: Column, site_pages: Column, cuts: dict[str, Column]) -> Column:
    small, relative = F.lit("P3"), F.lit("P3")
    for band in ("P2", "P1", "P0"):
        small = F.when(score >= ABSOLUTE_BANDS[band], band).otherwise(small)
        relative = F.when(score >= cuts[band], band).otherwise(relative)
    return F.when(site_pages < SMALL_SITE, small).otherwise(relative)


def band_and_rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """Add ``band`` (relative to the site's own distribution, absolute below eight pages) and ``rank``.

    The cut-offs of a site are the scores at the ranks of its shares. They reach the rows beside the range partitions of the site,
    so no task sorts or joins a whole site.
    """
    order = [F.col(score).desc(), F.col("page_id").asc()]
    ranked = cut(row_numbers(scored, ["site_id"], order, "rank", total="_pages", keep_part=True))
    at = {band: F.greatest(F.lit(1), F.floor(F.col("_pages") * F.lit(share))) for band, share in BAND_SHARES.items()}
    cuts = ranked.groupBy("site_id").agg(*[F.max(F.when(F.col("rank") == row, F.col(score))).alias(f"_{band}") for band, row in at.items()])
    spans = ranked.select("site_id", PART).distinct().join(cuts, "site_id")
    band = _band(F.col(score), F.col("_pages"), {b: F.col(f"_{b}") for b in BAND_SHARES})
    return ranked.join(spans, ["site_id", PART]).withColumn("band", band).drop(PART, "_pages", *[f"_{b}" for b in BAND_SHARES])


def score_pages(raw: DataFrame, weights: DataFrame) -> DataFrame:
    """Within-site percent ranks of the raw components and the blended 0-100 score."""
    ranked = percent_ranks(raw, ["site_id"], {f"{c}_raw": f"{c}_component" for c in COMPONENTS})
    weighted = ranked.join(weights.select("site_id", *[F.col(c).alias(f"w_{c}") for c in COMPONENTS]), "site_id")
    rounded = weighted.withColumns({f"{c}_component": rnd(f"{c}_component", 6) for c in COMPONENTS})
    blend = sum((F.col(f"w_{c}") * F.col(f"{c}_component") for c in COMPONENTS), F.lit(0.0))
    return rounded.withColumn("score", rnd(100.0 * blend, 2)).drop(*[f"w_{c}" for c in COMPONENTS])


def page_priority(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Score, band and rank every active page of every site.

    ``metrics`` is the output of :func:`operators.metrics.page_metrics`, ``weights`` the effective
    weights per site. Raw components and scores are each read by several branches, so both narrow
    frames are materialised instead of recomputing the fact aggregation per branch.
    """
    raw = cut(raw_components(metrics.filter("is_active")))
    return band_and_rank(cut(score_pages(raw, weights)))


def score_preview(
    pages_with_metrics: DataFrame, configured: DataFrame, sources: DataFrame, overrides: dict[str, float], limit: int = 20
) -> DataFrame:
    """The top pages of every site under hypothetical weights; nothing is written.

    ``overrides`` replace single components of the configured site weights, which are then
    normalised and redistributed as in a real run.
    """
    mixed = {c: F.lit(float(overrides[c])) if c in overrides else F.col(c) for c in COMPONENTS}
    normal = normalised_weights(mixed, DEFAULT_WEIGHTS)
    frame = configured.select("site_id", *[w.alias(c) for c, w in normal.items()])
    return page_priority(pages_with_metrics, share_weights(frame, sources)).filter(F.col("rank") <= limit)


def score_history(priority: DataFrame, metrics: DataFrame, weights: DataFrame, sources: DataFrame, *, computed_date: str) -> DataFrame:
    """Append-only history rows: score, weights, raw values, metrics and data sources of one run."""
    w = weights.select(
        "site_id", F.create_map(*[x for c in COMPONENTS for x in (F.lit(c), F.col(c))]).alias("weights")
    )
    flags = [F.when(F.coalesce(F.col(f"has_{s}"), F.lit(False)), F.lit(s)) for s in ("ga4", "gsc", "semrush")]
    breakdown = F.struct(
        F.create_map(*[x for c in COMPONENTS for x in (F.lit(c), F.col(f"{c}_raw"))]).alias("raw"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in BREAKDOWN_METRICS]).alias("metrics"),
        "seo_score",
        "highest_severity",
        "issue_count",
    )
    return (
        priority.join(metrics.drop("site_id"), "page_id")
        .join(w, "site_id")
        .join(sources, "site_id", "left")
        .select(
            "site_id",
            "page_id",
            "score",
            "band",
            "rank",
            *[f"{c}_component" for c in COMPONENTS],
            "weights",
            breakdown.alias("breakdown"),
            F.array_compact(F.array(*flags, F.lit("seo"))).alias("data_sources"),
            F.to_date(F.lit(computed_date)).alias("computed_date"),
        )
    )


def append_history(history: DataFrame, path: str) -> None:
    """Append one run; partitioned by run date so retention drops whole partitions."""
    history.write.mode("append").partitionBy("computed_date").parquet(path)
