"""Recommendation scoring, tier routing and model-call selection for all sites in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import impact as fx
from ..functions import tiering
from ..functions.catalogue import with_catalogue
from ..functions.numeric import lookup
from ..operators.ranking import newest_per_key, row_numbers, top_per_key
from ..operators.settings import overlay
from ..session import cut

PER_PAGE = 12
METRICS = ("clicks", "impressions", "position", "sessions", "conversions", "revenue", "engagement_rate")


def with_site_totals(metrics: DataFrame) -> DataFrame:
    """Add each site's revenue and conversions (aggregate and join, never a whole-site window)."""
    totals = metrics.groupBy("site_id").agg(
        F.sum("revenue").alias("site_revenue"), F.sum("conversions").alias("site_conversions")
    )
    return metrics.join(totals, "site_id")


def candidates(pages: DataFrame, issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Findings to score: open issues, one row per intent mismatch, one per CTR shortfall.

    ``pages`` carries metrics; the result has page_id, check_type, severity, method, issue_id.
    """
    issue_rows = issues.filter("not is_resolved").select(
        "page_id", "check_type", "severity", F.lit("rules").alias("method"), "issue_id", F.col("description").alias("current_state")
    )
    mismatch_rows = profiles.filter("intent_mismatch").select(
        "page_id",
        F.lit("search_intent_mismatch").alias("check_type"),
        lookup(F.coalesce("mismatch_severity", F.lit("")), fx.MISMATCH_SEVERITY, "HIGH").alias("severity"),
        F.lit("statistical").alias("method"),
        F.lit(None).cast("long").alias("issue_id"),
        F.col("mismatch_explanation").alias("current_state"),
    )
    pct = lambda c: F.format_string("%.1f", fx.rnd(100.0 * c, 1))
    shortfall = pages.withColumn("severity", fx.ctr_opportunity_severity()).filter("severity is not null")
    ctr_rows = shortfall.select(
        "page_id",
        F.lit("ctr_opportunity").alias("check_type"),
        "severity",
        F.lit("statistical").alias("method"),
        F.lit(None).cast("long").alias("issue_id"),
        F.concat(
            pct(F.col("clicks") / F.col("impressions")), F.lit("% CTR at position "), F.format_string("%.1f", F.col("position")),
            F.lit(" against a "), pct(fx.expected_ctr("position")), F.lit("% expectation"),
        ).alias("current_state"),
    )
    return issue_rows.unionByName(mismatch_rows).unionByName(ctr_rows)


def page_factors(patterns: tuple[str, ...] = ()) -> dict[str, Column]:
    """Factors that all findings of a page share."""
    return {
        "search_opportunity": fx.search_opportunity(),
        "activity_opportunity": fx.activity_opportunity(),
        "business_relevance": fx.business_relevance(patterns=patterns),
    }


def finding_factors() -> dict[str, Column]:
    return {
        "improvement_potential": fx.improvement_potential("ceiling", "severity"),
        "confidence": fx.data_confidence(method=F.col("method")),
    }


def factor_columns(patterns: tuple[str, ...] = ()) -> dict[str, Column]:
    return {**page_factors(patterns), **finding_factors()}


def page_basis(pages: DataFrame, weights: DataFrame | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Pages with metrics and site totals, and everything of the scores and sentences that no finding changes."""
    if weights is None:
        w = {k: F.lit(v) for k, v in fx.FACTOR_WEIGHTS.items()}
        rows = pages
    else:
        rows = pages.join(weights.select("site_id", *[F.col(k).alias(f"_s_{k}") for k in fx.FACTOR_WEIGHTS]), "site_id", "left")
        w = {k: F.coalesce(F.col(f"_s_{k}"), F.lit(v)) for k, v in fx.FACTOR_WEIGHTS.items()}
    kept = {f"_w_{k}": w[k] for k in ("improvement_potential", "confidence")}
    rows = rows.withColumns({**page_factors(patterns), **kept}).withColumns(fx.page_logs(w))
    texts = fx.page_texts(fx.business_basis("revenue", "conversions", "site_revenue", "site_conversions", patterns=patterns))
    return rows.withColumns(texts).drop(*[f"_s_{k}" for k in fx.FACTOR_WEIGHTS])


def score_candidates(found: DataFrame) -> DataFrame:
    """Score rows that carry check_type, severity, method and the columns of :func:`page_basis`."""
    rows = with_catalogue(found).withColumns(finding_factors())
    logs = fx.finding_logs(F.col("_w_improvement_potential"), F.col("_w_confidence"), "search_leverage", "activity_leverage")
    rows = rows.withColumns(logs).withColumns(fx.recommendation_scores())
    out = rows.withColumns({"reason": fx.reason_text(), "expected_outcome": fx.expected_outcome_text(), "confidence_score": F.col("confidence")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def scored_findings(
    pages: DataFrame, issues: DataFrame, profiles: DataFrame, weights: DataFrame | None = None, patterns: tuple[str, ...] = ()
) -> DataFrame:
    """Scored findings of every page of ``pages``, which carries metrics and site totals.

    Pages are materialised, as shortfalls and scores both read them. What a page's numbers decide is worked out once a page.
    """
    facts = cut(pages.select("page_id", "site_id", "path", "site_revenue", "site_conversions", *METRICS))
    return score_candidates(candidates(facts, issues, profiles).join(page_basis(facts, weights, patterns), "page_id"))


def impact_weights(sites: DataFrame, settings: DataFrame) -> DataFrame:
    return overlay(sites, settings, "impact_weights", fx.FACTOR_WEIGHTS, floor_zero=False)


def best_per_page(scored: DataFrame, k: int = PER_PAGE) -> DataFrame:
    """The strongest ``k`` recommendations of every page."""
    order = [F.col("overall_priority").desc(), F.col("recommendation_type").asc(), F.col("issue_id").asc_nulls_last()]
    return top_per_key(scored, ["page_id"], order, k, "page_rank")


def impact_rank(pages: DataFrame, scored: DataFrame) -> DataFrame:
    """Every page with its best score and its rank inside the site (1 = highest)."""
    best = scored.groupBy("page_id").agg(F.max("overall_priority").alias("impact_score"))
    ranked = cut(pages.join(best, "page_id", "left").withColumn("_best", F.coalesce("impact_score", F.lit(0.0))))  # ranking reads it twice
    return row_numbers(ranked, ["site_id"], [F.col("_best").desc(), F.col("page_id").asc()], "rank").drop("_best")


def open_issue_counts(issues: DataFrame) -> DataFrame:
    return issues.filter("not is_resolved").groupBy("page_id").agg(F.count(F.lit(1)).alias("open_issues"))


def routed_pages(ranked: DataFrame, issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Ranked pages with the tier that handles them and the reason."""
    flags = profiles.select("page_id", "intent_mismatch")
    rows = (
        ranked.join(open_issue_counts(issues), "page_id", "left")
        .join(flags, "page_id", "left")
        .withColumn("has_critical", F.col("highest_severity") == "CRITICAL")
    )
    decision = tiering.route_page(issues="open_issues")
    return rows.withColumn("_d", decision).withColumns({"page_tier": F.col("_d.tier"), "tier_reason": F.col("_d.reason")}).drop("_d")


def recommendation_scores(
    pages: DataFrame,
    issues: DataFrame,
    profiles: DataFrame,
    weights: DataFrame | None = None,
    patterns: tuple[str, ...] = (),
) -> DataFrame:
    """Scored, ranked and routed recommendations of every active page.

    ``pages`` carries metrics. The per-page best rows feed both the page ranking and the output, so
    they are materialised once.
    """
    active = with_site_totals(pages.filter("is_active"))
    best = cut(best_per_page(scored_findings(active, issues, profiles, weights, patterns)))
    ranked = pages.filter("is_active").select("page_id", "site_id", "highest_severity")
    routed = routed_pages(impact_rank(ranked, best), issues, profiles).select("page_id", F.col("rank").alias("impact_rank"), "page_tier")
    level, why = fx.priority_level(
        "overall_priority", "recommendation_type", F.when(F.col("issue_id").isNotNull(), F.col("severity")), "mismatch_severity"
    )
    keywords = profiles.select("page_id", "mismatch_severity", "primary_keywords", "secondary_keywords", "detected_intent")
    return (
        best.join(routed, "page_id")
        .join(keywords, "page_id", "left")
        .withColumns({"priority_level": level, "_why": why, "tier": tiering.route_finding()["tier"]})
        .select(
            "site_id",
            "page_id",
            "recommendation_type",
            F.col("label").alias("title"),
            "current_state",
            F.get("primary_keywords", F.lit(0)).alias("primary_keyword"),
            "secondary_keywords",
            F.col("detected_intent").alias("search_intent"),
            "search_impact_score",
            "user_activity_score",
            "business_impact_score",
            "overall_priority",
            "confidence_score",
            "priority_level",
            F.when(F.col("issue_id").isNotNull(), F.col("severity")).alias("severity"),
            "effort",
            F.concat("reason", F.lit(" Priority "), "priority_level", F.lit(": "), "_why", F.lit(".")).alias("reason"),
            "expected_outcome",
            "tier",
            "page_rank",
            "impact_rank",
            F.lit("detected").alias("status"),
            "issue_id",
        )
    )


def tier_counts(routed: DataFrame) -> DataFrame:
    """Pages per tier and number of model calls, per site."""
    return routed.groupBy("site_id").agg(
        *[F.count_if(F.col("page_tier") == t).alias(t) for t in tiering.TIERS],
        F.count_if(F.col("page_tier").isin("ai", "deep_ai")).alias("ai_calls"),
    )


def selection_preview(
    pages: DataFrame, scores: DataFrame, profiles: DataFrame, *, limit: int = tiering.MODEL_PAGES, threshold: float = 100.0
) -> DataFrame:
    """Which pages would get a model call, and why, in impact order per site.

    Pages are ranked by best impact where the site has scores, else by page priority. The budget is
    the first ``limit`` selected pages of a site in rank order: instead of a running
    count over a whole site, the rank of the last page inside the budget is found with a per-site top-k.
    """
    best = scores.groupBy("page_id").agg(F.max("overall_priority").alias("impact_score"))
    flags = profiles.filter("intent_mismatch").select("page_id", F.lit(True).alias("intent_mismatch"))
    rows = (
        pages.filter("is_active")
        .join(best, "page_id", "left")
        .join(flags, "page_id", "left")
        .fillna({"intent_mismatch": False})
    )
    have = rows.groupBy("site_id").agg(F.max(F.col("impact_score").isNotNull()).alias("have_impact"))
    rows = rows.join(have, "site_id").withColumns(
        {
            "_key": F.when(F.col("have_impact"), F.coalesce("impact_score", F.lit(0.0))).otherwise(F.coalesce("priority_score", F.lit(0.0))),
            "_health": F.coalesce("seo_score", F.lit(0.0)),
            "has_critical": F.col("highest_severity") == "CRITICAL",
        }
    )
    order = [F.col("_key").desc(), F.col("_health").asc(), F.col("page_id").asc()]
    ranked = cut(row_numbers(rows, ["site_id"], order, "rank").drop("_key", "_health"))

    seo = F.col("seo_score")
    idle = (F.coalesce("issue_count", F.lit(0)) == 0) & ~F.col("intent_mismatch")
    healthy = F.concat(F.lit("healthy (SEO "), seo.cast("string"), F.lit(f" > {threshold})"))
    at_or_below = F.concat(F.lit("SEO "), seo.cast("string"), F.lit(f" is at or below the {threshold} threshold"))
    routed = tiering.route_page(pages=limit)
    scored, over = F.col("impact_score").isNotNull(), seo > threshold
    routed_model = routed["tier"].isin("ai", "deep_ai")

    def decision(selected: bool, tier: Column | str, reason: Column | str) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(F.lit(selected).alias("selected"), as_col(tier).alias("tier"), as_col(reason).alias("reason"))

    wish = (
        F.when(seo.isNull(), decision(False, "rules", "not audited yet"))
        .when(idle, decision(False, "rules", "no outstanding issues"))
        .when(~scored & F.col("has_critical"), decision(True, "ai", "carries a CRITICAL issue"))
        .when(~scored & over, decision(False, "statistical", healthy))
        .when(~scored, decision(True, "ai", at_or_below))
        .when(routed_model & over, decision(False, "statistical", healthy))
        .when(routed_model, decision(True, routed["tier"], routed["reason"]))
        .otherwise(decision(False, routed["tier"], routed["reason"]))
    )
    wished = ranked.withColumn("_w", wish)
    budget_end = (
        top_per_key(wished.filter("_w.selected").select("site_id", "rank"), ["site_id"], [F.col("rank").asc()], limit, "_n")
        .filter(F.col("_n") == limit)
        .select("site_id", F.col("rank").alias("_last"))
    )
    beyond = F.col("_last").isNotNull() & (F.col("rank") > F.col("_last")) & seo.isNotNull() & ~idle
    final = F.when(
        beyond, decision(False, "statistical", f"outside the top {limit} pages by priority")
    ).otherwise(F.col("_w"))
    return (
        wished.join(budget_end, "site_id", "left")
        .withColumn("_f", final)
        .select("site_id", "page_id", "rank", "impact_score", "_f.selected", "_f.tier", "_f.reason")
    )


def reusable_findings(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Newest completed finding of a page that was made for its current content hash."""
    done = findings.filter("status = 'completed'").select("page_id", "content_hash", "finding_id", "payload")
    newest = newest_per_key(done, ["page_id", "content_hash"], ["finding_id"])
    return pages.filter("content_hash is not null").select("page_id", "content_hash").join(newest, ["page_id", "content_hash"])


def opportunity_backfill(pages: DataFrame, profiles: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Traffic and lead potential for every active page; missing profiles are neutral."""
    known = profiles.select("page_id", "keyword_opportunity_score", "intent_confidence", "detected_intent")
    rows = with_site_totals(pages.filter("is_active")).join(known, "page_id", "left")
    rows = rows.withColumn("traffic_potential_score", fx.traffic_potential())
    return rows.withColumn("lead_potential_score", fx.lead_potential(patterns=patterns)).select(
        "site_id", "page_id", "traffic_potential_score", "lead_potential_score"
    )
