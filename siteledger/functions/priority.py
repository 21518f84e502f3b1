"""Raw priority components and fallback scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col, dbl, log_scale, lookup, num, rnd

# Severity weights, component weights, sub-weights and the first expected-CTR curve.
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.72, "MEDIUM": 0.40, "LOW": 0.15, "NONE": 0.0}
DEFAULT_WEIGHTS = {
    "seo_severity": 0.40,
    "ga4_activity": 0.30,
    "gsc_search": 0.20,
    "semrush_opportunity": 0.10,
}
COMPONENT_SOURCE = {
    "seo_severity": "seo",
    "ga4_activity": "ga4",
    "gsc_search": "gsc",
    "semrush_opportunity": "semrush",
}
ACTIVITY_WEIGHTS = {"users": 0.35, "sessions": 0.15, "conversions": 0.30, "revenue": 0.20}
SEARCH_WEIGHTS = {"clicks": 0.45, "impressions": 0.30, "position": 0.15, "ctr_gap": 0.10}
OPPORTUNITY_WEIGHTS = {
    "organic_keywords": 0.30,
    "organic_traffic": 0.25,
    "opportunity_volume": 0.30,
    "backlinks": 0.15,
}
CTR_BY_RANK = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.03, 9: 0.026, 10: 0.023}
CTR_SECOND_PAGE = 0.015
CTR_BEYOND = 0.005


def seo_severity_raw(severity: Column | str, score: Column | str, issues: Column | str) -> Column:
    worst = lookup(F.upper(col(severity)), SEVERITY_WEIGHT, 0.0)
    deficit = F.coalesce((100.0 - dbl(score)) / 100.0, F.lit(0.5))
    volume = F.least(F.lit(1.0), num(issues) / 12.0)
    return rnd(0.55 * worst + 0.35 * deficit + 0.10 * volume, 6)


def ga4_activity_raw(users="users", sessions="sessions", conversions="conversions", revenue="revenue") -> Column:
    w = ACTIVITY_WEIGHTS
    return rnd(
        w["users"] * log_scale(users)
        + w["sessions"] * log_scale(sessions)
        + 2.0 * w["conversions"] * log_scale(conversions)
        + w["revenue"] * log_scale(revenue),
        6,
    )


def expected_ctr_by_rank(position: Column | str) -> Column:
    """Expected CTR for the position rounded half-even to a whole rank; 0 without a position."""
    p = dbl(position)
    rank = F.bround(p, 0).cast("int")
    tail = F.when(rank <= 20, F.lit(CTR_SECOND_PAGE)).otherwise(F.lit(CTR_BEYOND))
    curve = F.coalesce(lookup(rank, CTR_BY_RANK, None), tail)
    return F.when(p.isNull() | (p <= 0), F.lit(0.0)).otherwise(curve)


def relative_ctr_gap(ctr: Column | str, position: Column | str, impressions: Column | str, floor: int) -> Column:
    """Share of the expected CTR the page does not earn, once it has ``floor`` impressions."""
    expected = expected_ctr_by_rank(position)
    actual = dbl(ctr)
    missing = (num(impressions) >= floor) & actual.isNotNull() & (expected > 0) & (actual < expected)
    return F.when(missing, F.least(F.lit(1.0), (expected - actual) / expected)).otherwise(F.lit(0.0))


def gsc_search_raw(clicks="clicks", impressions="impressions", ctr="ctr", position="position") -> Column:
    w = SEARCH_WEIGHTS
    p = dbl(position)
    headroom = (
        F.when(p.isNull() | (p <= 0), 0.0)
        .when(p.between(4, 20), 1.0)
        .when(p < 4, 0.35)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (p - 20.0) / 60.0) * 0.5)
    )
    return rnd(
        w["clicks"] * log_scale(clicks)
        + w["impressions"] * log_scale(impressions)
        + 5.0 * w["position"] * headroom
        + 5.0 * w["ctr_gap"] * relative_ctr_gap(ctr, position, impressions, 100),
        6,
    )


def semrush_opportunity_raw() -> Column:
    return rnd(sum((w * log_scale(c) for c, w in OPPORTUNITY_WEIGHTS.items()), F.lit(0.0)), 6)


def search_impact_score(impressions="impressions", ctr="ctr", position="position", clicks="clicks") -> Column:
    """0-100 fallback search score; 50 when there is no search signal at all."""
    p = dbl(position)
    place = (
        F.when(p.isNull() | (p <= 0), 0.3)
        .when(p.between(4, 20), 1.0 - (p - 4.0) / 25.0)
        .when(p < 4, 0.5)
        .otherwise(F.greatest(F.lit(0.1), 1.0 - p / 100.0))
    )
    volume = F.least(F.lit(1.0), F.log1p(num(impressions)) / F.log1p(F.lit(10000.0)))
    gap = relative_ctr_gap(ctr, position, impressions, 50)
    has_signal = (num(clicks) != 0) | (num(impressions) != 0) | (num(position) != 0)
    scaled = clamp(100.0 * (0.45 * gap + 0.35 * place + 0.20 * volume), 10.0, 100.0)
    return F.when(has_signal, rnd(scaled, 1)).otherwise(F.lit(50.0))


def user_activity_score(
    users="users", sessions="sessions", conversions="conversions", revenue="revenue", engagement="engagement_rate"
) -> Column:
    """0-100 fallback activity score; 50 when there is no activity signal at all."""

    def share(c, full: float) -> Column:
        return F.least(F.lit(1.0), F.log1p(num(c)) / F.log1p(F.lit(full)))

    engaged = F.coalesce(clamp(dbl(engagement)), F.lit(0.5))
    has_signal = (num(users) != 0) | (num(sessions) != 0) | (num(conversions) != 0) | (num(revenue) != 0)
    scaled = 100.0 * (
        0.35 * share(sessions, 5000.0)
        + 0.35 * share(conversions, 100.0)
        + 0.15 * share(revenue, 1000.0)
        + 0.15 * engaged
    )
    return F.when(has_signal, rnd(clamp(scaled, 10.0, 100.0), 1)).otherwise(F.lit(50.0))


def combined_impact(search: Column | str, activity: Column | str, confidence: Column | str) -> Column:
    """Blend of both fallback scores, damped by confidence."""
    return (0.55 * num(search) + 0.45 * num(activity)) * (0.5 + 0.5 * num(confidence))


def normalised_weights(weights: dict[str, Column], fallback: dict[str, float]) -> dict[str, Column]:
    """Scale the weights to sum to one (six decimals); all-zero falls back to ``fallback``."""
    positive = {k: F.greatest(F.lit(0.0), num(w)) for k, w in weights.items()}
    total = sum(positive.values(), F.lit(0.0))
    return {
        k: F.when(total > 0, rnd(w / total, 6)).otherwise(F.lit(float(fallback[k]))) for k, w in positive.items()
    }


def redistributed_weights(weights: dict[str, Column], available: dict[str, Column]) -> dict[str, Column]:
    """Weights over the available sources only. ``available`` maps source name to a boolean Column.

    When every available weight is zero the defaults of all components apply, exactly as
    normalising an all-zero set does.
    """
    kept = {k: F.when(available[COMPONENT_SOURCE[k]], num(w)).otherwise(F.lit(0.0)) for k, w in weights.items()}
    return normalised_weights(kept, DEFAULT_WEIGHTS)
