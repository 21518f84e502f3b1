"""Impact factors of a recommendation, potentials and their explanations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col, dbl, lookup, num, rnd

# Factor weights, floor, second expected-CTR curve, severity factors, intent likelihood.
FACTOR_WEIGHTS = {
    "search_opportunity": 0.28,
    "activity_opportunity": 0.22,
    "improvement_potential": 0.25,
    "business_relevance": 0.15,
    "confidence": 0.10,
}
BUSINESS_LENS = 0.45
FACTOR_FLOOR = 0.05
NEUTRAL = 0.50
CTR_BY_POSITION = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.03, 9: 0.028, 10: 0.025}
SEVERITY_FACTOR = {"CRITICAL": 1.00, "HIGH": 0.80, "MEDIUM": 0.55, "LOW": 0.30}
MISMATCH_SEVERITY = {"P0": "CRITICAL", "P1": "HIGH", "P2": "MEDIUM"}
INTENT_LIKELIHOOD = {
    "transactional": 1.00,
    "commercial": 0.90,
    "local": 0.65,
    "navigational": 0.55,
    "informational": 0.30,
}
HEALTHY_CONVERSION = 0.05
HEALTHY_ENGAGEMENT = 0.70


def floored(c: Column) -> Column:
    return clamp(c, FACTOR_FLOOR, 1.0)


def expected_ctr(position: Column | str) -> Column:
    """Expected CTR of the first listed position at or after ``position``; slow decay past page one."""
    p = dbl(position)
    out = F.when(p.isNull() | (p <= 0), F.lit(0.0)).when(p >= 11, F.greatest(F.lit(0.002), 0.25 / p))
    for place, ctr in CTR_BY_POSITION.items():
        out = out.when(p <= place, F.lit(ctr))
    return out.otherwise(F.lit(CTR_BY_POSITION[10]))


def ctr_gap(clicks="clicks", impressions="impressions", position="position") -> Column:
    target, i = expected_ctr(position), num(impressions)
    gap = clamp((target - num(clicks) / i) / target)
    return F.when((target > 0) & (i >= 50), gap).otherwise(F.lit(0.0))


def search_opportunity(clicks="clicks", impressions="impressions", position="position") -> Column:
    """Unclaimed search performance, 0-1; neutral 0.45 without impressions."""
    p, i = dbl(position), num(impressions)
    demand = F.least(F.lit(1.0), F.log10(i + 1.0) / 5.0)
    headroom = (
        F.when(p.isNull(), 0.5).when(p <= 3, 0.25).when(p <= 10, 1.0).when(p <= 20, 0.85).when(p <= 50, 0.45).otherwise(0.20)
    )
    blend = 0.40 * demand + 0.30 * headroom + 0.30 * ctr_gap(clicks, impressions, position)
    return F.when(i <= 0, F.lit(0.45)).otherwise(floored(blend))


def activity_opportunity(sessions="sessions", conversions="conversions", engagement="engagement_rate") -> Column:
    """On-site activity left to gain, 0-1; neutral 0.40 without sessions."""
    s = num(sessions)
    traffic = F.least(F.lit(1.0), F.log10(s + 1.0) / 4.0)
    shortfall = F.coalesce(clamp((HEALTHY_ENGAGEMENT - dbl(engagement)) / HEALTHY_ENGAGEMENT), F.lit(0.5))
    unconverted = clamp((HEALTHY_CONVERSION - num(conversions) / s) / HEALTHY_CONVERSION)
    blend = 0.40 * traffic + 0.35 * shortfall + 0.25 * F.when(s >= 30, unconverted).otherwise(F.lit(0.5))
    return F.when(s <= 0, F.lit(0.40)).otherwise(floored(blend))


def improvement_potential(ceiling: Column | str, severity: Column | str, issue_present: Column | None = None) -> Column:
    """Catalogue ceiling times severity factor; the floor when nothing is wrong."""
    value = floored(dbl(ceiling) * lookup(F.upper(F.coalesce(col(severity), F.lit(""))), SEVERITY_FACTOR, 0.55))
    return value if issue_present is None else F.when(issue_present, value).otherwise(F.lit(FACTOR_FLOOR))


def matched_path(path: Column | str, patterns: tuple[str, ...]) -> Column:
    """The first configured high-value pattern contained in the path, null when none is."""
    hits = [F.when(F.lower(col(path)).contains(p.lower()), F.lit(p)) for p in patterns if p]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def business_basis(revenue, conversions, site_revenue, site_conversions, path="path", patterns: tuple[str, ...] = ()) -> Column:
    """Which signal decides business relevance, as text."""
    hit = matched_path(path, patterns)
    return (
        F.when((num(site_revenue) > 0) & (num(revenue) > 0), "share of site revenue")
        .when((num(site_conversions) > 0) & (num(conversions) > 0), "share of site conversions")
        .when(hit.isNotNull(), F.concat(F.lit("matched configured high-value path '"), hit, F.lit("'")))
        .otherwise("no revenue, conversion or configured signal — neutral")
    )


def business_relevance(
    revenue="revenue", conversions="conversions", site_revenue="site_revenue", site_conversions="site_conversions",
    path="path", patterns: tuple[str, ...] = (),
) -> Column:
    """Revenue share leads, then conversion share, then configured paths, else neutral 0.50."""

    def share(part, whole) -> Column:
        return floored(F.sqrt(F.least(F.lit(1.0), 8.0 * num(part) / num(whole))))

    return (
        F.when((num(site_revenue) > 0) & (num(revenue) > 0), share(revenue, site_revenue))
        .when((num(site_conversions) > 0) & (num(conversions) > 0), share(conversions, site_conversions))
        .when(matched_path(path, patterns).isNotNull(), F.lit(0.85))
        .otherwise(F.lit(0.50))
    )


def data_confidence(impressions="impressions", sessions="sessions", method: Column | str = "statistical") -> Column:
    """Trust from data sufficiency only, 0.10 to 0.95."""
    i, s = num(impressions), num(sessions)
    m = F.lit(method) if isinstance(method, str) else method
    score = (
        0.35
        + F.when(i <= 0, 0.0).when(i >= 100, 0.25).otherwise(0.15)
        + F.when(s <= 0, 0.0).when(s >= 100, 0.20).otherwise(0.12)
        + F.when((i > 0) & (s > 0), 0.10).otherwise(0.0)
        + F.when(m == "ai", 0.05).when(m == "rules", -0.05).otherwise(0.0)
    )
    return clamp(rnd(score, 3), 0.10, 0.95)


def weighted_log(factor: Column, weight: Column) -> Column:
    """What one factor, floored at 0.05, adds to the logarithm of the mean."""
    return F.when(weight > 0, weight * F.ln(F.greatest(factor, F.lit(FACTOR_FLOOR)))).otherwise(F.lit(0.0))


def mean_of_logs(logs: list[Column], total: Column) -> Column:
    return F.when(total > 0, F.exp(sum(logs, F.lit(0.0)) / total)).otherwise(F.lit(0.0))


def geometric_mean(factors: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Weighted geometric mean of factors floored at 0.05."""
    return mean_of_logs([weighted_log(factors[k], w) for k, w in weights.items()], sum(weights.values(), F.lit(0.0)))


def page_logs(weights: dict[str, Column]) -> dict[str, Column]:
    """The part of the scores that only the page and its site decide: totals of the weights, logarithms of three factors."""
    lens = {**weights, "business_relevance": F.lit(BUSINESS_LENS)}
    log = lambda k, w: weighted_log(F.col(k), w[k])
    return {
        "_total": sum(weights.values(), F.lit(0.0)),
        "_total_lens": sum(lens.values(), F.lit(0.0)),
        "_log_search": log("search_opportunity", weights),
        "_log_activity": log("activity_opportunity", weights),
        "_log_relevance": log("business_relevance", weights),
        "_log_lens": log("business_relevance", lens),
        "_neutral_search": weighted_log(F.lit(NEUTRAL), weights["search_opportunity"]),
        "_neutral_activity": weighted_log(F.lit(NEUTRAL), weights["activity_opportunity"]),
    }


def finding_logs(potential_weight: Column, confidence_weight: Column, search_leverage, activity_leverage) -> dict[str, Column]:
    """The part of the scores that the finding decides."""

    def leveraged(leverage) -> Column:
        return weighted_log(floored(F.col("improvement_potential") * (0.35 + 0.65 * dbl(leverage))), potential_weight)

    return {
        "_log_potential": weighted_log(F.col("improvement_potential"), potential_weight),
        "_log_potential_search": leveraged(search_leverage),
        "_log_potential_activity": leveraged(activity_leverage),
        "_log_confidence": weighted_log(F.col("confidence"), confidence_weight),
    }


def recommendation_scores() -> dict[str, Column]:
    """Search, activity, business and overall scores (0-100, one decimal) of rows with page and finding logarithms."""

    def scored(search: str, activity: str, potential: str, relevance: str = "_log_relevance", total: str = "_total") -> Column:
        logs = [F.col(c) for c in (search, activity, potential, relevance, "_log_confidence")]
        return rnd(100.0 * mean_of_logs(logs, F.col(total)), 1)

    return {
        "search_impact_score": scored("_log_search", "_neutral_activity", "_log_potential_search"),
        "user_activity_score": scored("_neutral_search", "_log_activity", "_log_potential_activity"),
        "business_impact_score": scored("_log_search", "_log_activity", "_log_potential", "_log_lens", "_total_lens"),
        "overall_priority": scored("_log_search", "_log_activity", "_log_potential"),
    }


def _count(c) -> Column:
    return F.format_number(F.floor(num(c)), 0)


def _percent(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", rnd(100.0 * c, 1)), F.lit("%"))


# The sentences of this and the following functions are results that must match.
def page_texts(basis: Column) -> dict[str, Column]:
    """The sentences that a page's own numbers give, the same for all of its findings; null where there is nothing to say."""
    i, s, p, e = num("impressions"), num("sessions"), dbl("position"), dbl("engagement_rate")
    ctr, target = rnd(num("clicks") / i, 4), rnd(expected_ctr("position"), 4)
    under = F.when(
        (target > 0) & (ctr < target),
        F.concat(
            F.lit(", with a "), _percent(ctr), F.lit(" click-through rate against the "), _percent(target),
            F.lit(" typical for that position"),
        ),
    ).otherwise(F.lit(""))
    search = (
        F.when(
            (i >= 50) & p.isNotNull(),
            F.concat(
                F.lit("This URL receives "), _count(i), F.lit(" impressions at average position "),
                F.format_string("%.1f", p), under, F.lit("."),
            ),
        )
        .when(i > 0, F.concat(F.lit("This URL receives "), _count(i), F.lit(" search impressions.")))
        .otherwise(F.lit("This URL has no search impressions recorded in the current window."))
    )
    rate = F.when(
        e.isNotNull(), F.concat(F.lit(" at a "), F.format_string("%.0f", F.bround(100.0 * rnd(e, 6), 0)), F.lit("% engagement rate."))
    ).otherwise(F.lit("."))
    activity = F.when(s > 0, F.concat(F.lit("It draws "), _count(s), F.lit(" sessions"), rate))
    weighting = F.when(~basis.contains("no revenue"), F.concat(F.lit("Business weighting: "), basis, F.lit(".")))
    return {"_search_text": search, "_activity_text": activity, "_weighting_text": weighting, "_clicks_text": clicks_text()}


def reason_text(mechanism="mechanism") -> Column:
    """Why the recommendation matters, around the sentences of its page."""
    matters = F.concat(F.lit("Fixing this matters because "), col(mechanism), F.lit("."))
    return F.concat_ws(" ", "_search_text", "_activity_text", matters, "_weighting_text")


def clicks_text() -> Column:
    """Recoverable clicks when a clear CTR gap exists, else null."""
    i = num("impressions")
    gap = rnd(ctr_gap(), 3)
    recoverable = F.floor(rnd(i * (rnd(expected_ctr("position"), 4) - rnd(num("clicks") / i, 4)), 6))
    clicks = F.concat(
        F.lit("Closing the click-through gap at the current ranking would be worth roughly "), F.format_number(recoverable, 0),
        F.lit(
            " additional clicks per window if the snippet performs to the position average. "
            "Not guaranteed — ranking and SERP layout can shift."
        ),
    )
    return F.when((gap > 0.25) & (i >= 100) & (recoverable > 0), clicks)


def expected_outcome_text(search_score="search_impact_score", activity_score="user_activity_score") -> Column:
    """What to expect: the page's recoverable clicks, else the stronger of the two scores."""
    lead = F.when(dbl(search_score) >= dbl(activity_score), "search performance").otherwise("on-site user activity")
    general = F.concat(
        F.lit("Expected to improve "), lead, F.lit(" for this URL. Search impact "),
        F.format_string("%.0f", F.bround(dbl(search_score), 0)), F.lit("/100, user activity impact "),
        F.format_string("%.0f", F.bround(dbl(activity_score), 0)),
        F.lit("/100. SEO outcomes cannot be guaranteed; treat this as a ranked expectation, not a promise."),
    )
    return F.coalesce("_clicks_text", general)


def priority_level(overall, check_type, severity, mismatch) -> tuple[Column, Column]:
    """(level, reason): explicit conditions first, score bands last."""
    i, p = num("impressions"), dbl("position")
    ctr = F.when(i > 0, num("clicks") / i)
    critical = F.coalesce(col(severity) == "CRITICAL", F.lit(False))
    blocked = critical & col(check_type).isin("http_status", "robots", "canonical_target")
    deep = (i >= 1000) & (p > 10)
    skipped = (i >= 1000) & (ctr < 0.01)
    o = dbl(overall)
    ladder = [
        (blocked, "P0", F.lit("page cannot be indexed or served correctly")),
        (col(mismatch) == "P0", "P0", F.lit("major search intent mismatch")),
        (deep, "P0", F.concat(F.lit("high-demand page ranking at position "), F.format_string("%.0f", F.bround(p, 0)))),
        (critical, "P0", F.lit("severe technical issue")),
        (skipped, "P0", F.concat(_count(i), F.lit(" impressions at "), _percent(ctr), F.lit(" CTR"))),
        (o >= 70, "P1", F.lit("strong opportunity for growth")),
        (o >= 45, "P2", F.lit("useful optimisation with lower expected impact")),
        (F.lit(True), "P3", F.lit("minor improvement")),
    ]
    level, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, text in reversed(ladder):
        level = F.when(condition, F.lit(name)).otherwise(level)
        why = F.when(condition, text).otherwise(why)
    return level, why


def ctr_opportunity_severity() -> Column:
    """HIGH or MEDIUM when a page under-earns clicks at its position, else null."""
    i, target = num("impressions"), expected_ctr("position")
    ctr = num("clicks") / i
    candidate = (i >= 200) & dbl("position").isNotNull() & (target > 0) & (ctr < 0.75 * target)
    return F.when(candidate, F.when(ctr < 0.4 * target, "HIGH").otherwise("MEDIUM"))


def traffic_potential(keyword_score="keyword_opportunity_score", confidence="intent_confidence", seo_score="seo_score") -> Column:
    """0-100 additional relevant traffic; missing inputs are neutral."""

    def unit(c, scale: float) -> Column:
        return rnd(F.coalesce(clamp(dbl(c) / scale), F.lit(NEUTRAL)), 4)

    return rnd(
        100.0
        * (
            0.65 * rnd(search_opportunity(), 4)
            + 0.20 * unit(keyword_score, 100.0)
            + 0.10 * unit(confidence, 1.0)
            + 0.05 * unit(seo_score, 100.0)
        ),
        1,
    )


def lead_potential(traffic="traffic_potential_score", intent="detected_intent", patterns: tuple[str, ...] = ()) -> Column:
    """0-100 business value; money leads, the classified intent nudges."""
    s = num("sessions")
    likelihood = lookup(F.lower(F.coalesce(col(intent), F.lit(""))), INTENT_LIKELIHOOD, NEUTRAL)
    commercial = clamp(0.65 * business_relevance(patterns=patterns) + 0.35 * likelihood)
    conversion = F.when(s >= 30, clamp(num("conversions") / s / HEALTHY_CONVERSION)).otherwise(F.lit(NEUTRAL))
    engaged = F.coalesce(clamp(dbl("engagement_rate")), F.lit(NEUTRAL))
    return rnd(
        100.0
        * (
            0.30 * rnd(commercial, 4)
            + 0.25 * rnd(clamp(num(traffic) / 100.0), 4)
            + 0.25 * rnd(conversion, 4)
            + 0.20 * rnd(engaged, 4)
        ),
        1,
    )
