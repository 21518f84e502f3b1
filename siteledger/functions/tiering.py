"""How far a page or a finding is worth taking: rules, statistics, model, larger model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, num

# Budgets, thresholds and the two families of findings.
MODEL_PAGES = 200
DEEP_PAGES = 20
MODEL_SCORE = 45.0
DEEP_SCORE = 75.0
TIERS = ("rules", "statistical", "ai", "deep_ai")
DETERMINISTIC = [
    "image_alt", "image_dimensions", "viewport", "empty_headings", "heading_depth", "canonical_multiple", "meta_description_multiple",
    "title_multiple", "external_links", "hreflang", "url_structure", "http_status", "robots", "redirect_chain", "broken_links",
]
CONTEXTUAL = [
    "title", "meta_description", "h1", "heading_structure", "content", "duplicate_content", "duplicate_title", "duplicate_meta_description",
    "search_intent_mismatch", "keyword_targeting", "ctr_opportunity", "cta_visibility", "structured_data",
]


def _points(score: Column) -> Column:
    return F.format_string("%.0f", F.bround(score, 0))


def ladder(rungs: list[tuple[Column, str, Column]]) -> Column:
    """First matching rung as struct(tier, reason)."""
    out = None
    for condition, tier, reason in rungs:
        value = F.struct(F.lit(tier).alias("tier"), reason.alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def page_rungs(rank, impact, critical, mismatch, issues, *, pages=MODEL_PAGES, deep=DEEP_PAGES, enabled=True, force=False):
    r, s = col(rank), num(impact)
    crit, wrong = F.coalesce(col(critical), F.lit(False)), F.coalesce(col(mismatch), F.lit(False))
    return [
        (F.lit(force), "ai", F.lit("explicitly requested")),
        ((num(issues) == 0) & ~wrong, "rules", F.lit("no outstanding issues")),
        (F.lit(not enabled), "statistical", F.lit("AI disabled by configuration")),
        ((r <= deep) & wrong, "deep_ai", F.lit(f"top {deep} by impact with a confirmed intent mismatch")),
        (
            (r <= deep) & (s >= DEEP_SCORE),
            "deep_ai",
            F.concat(F.lit(f"top {deep} by impact (score "), _points(s), F.lit(f" >= {DEEP_SCORE:.0f})")),
        ),
        ((r <= pages) & crit & (s < MODEL_SCORE), "ai", F.lit("carries a CRITICAL issue")),
        (
            (r <= pages) & (s >= MODEL_SCORE),
            "ai",
            F.concat(F.lit("impact "), _points(s), F.lit(f" >= {MODEL_SCORE:.0f} and inside the top {pages}")),
        ),
        (r > pages, "statistical", F.lit(f"outside the top {pages} pages by impact")),
        (
            F.lit(True),
            "statistical",
            F.concat(F.lit("impact "), _points(s), F.lit(f" below the AI threshold of {MODEL_SCORE:.0f}")),
        ),
    ]


def route_page(rank="rank", impact="impact_score", critical="has_critical", mismatch="intent_mismatch", issues="issue_count", **limits) -> Column:
    return ladder(page_rungs(rank, impact, critical, mismatch, issues, **limits))


def route_finding(check_type="recommendation_type", label="label", page_tier="page_tier", impact="overall_priority") -> Column:
    """A finding never exceeds its page's tier; a deterministic one never reaches a model."""
    c, tier, quoted = col(check_type), col(page_tier), F.concat(F.lit("'"), col(label), F.lit("'"))
    modelled = tier.isin("ai", "deep_ai")
    contextual = c.isin(CONTEXTUAL)
    return ladder(
        [
            (
                c.isin(DETERMINISTIC),
                "rules",
                F.concat(quoted, F.lit(" has a single determinate fix; no model input would change it")),
            ),
            (~modelled, "statistical", F.concat(F.lit("page resolved at "), tier)),
            (
                contextual & (tier == "deep_ai") & (num(impact) >= DEEP_SCORE),
                "deep_ai",
                F.lit("high-impact finding on a high-value page"),
            ),
            (contextual, "ai", F.concat(quoted, F.lit(" needs wording written for this page"))),
            (
                F.lit(True),
                "statistical",
                F.concat(quoted, F.lit(" is scored statistically; no contextual judgement required")),
            ),
        ]
    )
