"""Impact factors, recommendation scores, tier routing, selection and potentials."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.functions import impact as fx
from siteledger.functions import tiering
from siteledger.functions.catalogue import DEFAULT_TYPE, rows, with_catalogue
from siteledger.functions.numeric import rnd
from siteledger.plans import impact as plan

from .q_facts import page_metrics
from .registry import common, query, r
from .views import VIEWS

PATTERNS = ("/promo/", "anvil")
CHECK_TYPES = (
    "http_status,robots,canonical_multiple,canonical,canonical_target,redirect_chain,title,meta_description,open_graph,viewport,"
    "title_multiple,meta_description_multiple,h1,heading_structure,content,empty_headings,heading_depth,image_alt,image_dimensions,"
    "internal_links,broken_links,orphan_page,external_links,structured_data,url_structure,hreflang,duplicate_title,"
    "duplicate_meta_description,duplicate_content,unknown_check"
)

VIEWS.update(
    {
        "issue": f"""
            SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_orderkey AS audit_id, l_partkey AS page_id, {{part}}.p_brand AS brand,
                   split_part('{CHECK_TYPES}', ',', CAST(1 + l_suppkey % 30 AS INT)) AS check_type,
                   split_part('{CHECK_TYPES}', ',', CAST(1 + l_suppkey % 30 AS INT)) AS rule_id,
                   split_part('CRITICAL,HIGH,MEDIUM,LOW', ',', CAST(1 + (l_linenumber * 3 + l_suppkey) % 4 AS INT)) AS severity,
                   concat('finding ', l_suppkey % 30) AS title, concat('found on line ', l_linenumber) AS description,
                   l_returnflag = 'R' AS is_resolved, CAST(substr(p_brand, 7) AS INT) AS site_id
            FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""".replace("{part}.p_brand", "p_brand"),
        # Every seventh profile is that of a page that is gone (its id lies beyond those of the page table).
        "profile": """
            SELECT CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1000000000 ELSE p_partkey END AS page_id, CAST(substr(p_brand, 7) AS INT) AS site_id,
                   split_part('transactional,commercial,local,navigational,informational', ',', CAST(1 + p_partkey % 5 AS INT)) AS detected_intent,
                   CAST(40 + p_partkey % 60 AS DOUBLE) / 100 AS intent_confidence,
                   CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 1000 AS DOUBLE) / 10 END AS keyword_opportunity_score,
                   p_partkey % 4 = 0 AS intent_mismatch,
                   CASE WHEN p_partkey % 4 <> 0 THEN NULL WHEN p_partkey % 16 = 0 THEN 'P0' WHEN p_partkey % 16 = 4 THEN 'P1' WHEN p_partkey % 16 = 8 THEN 'P2' ELSE 'P3' END AS mismatch_severity,
                   concat('page ', p_partkey, ' serves another intent') AS mismatch_explanation,
                   p_name AS primary_keyword, lower(p_type) AS secondary_keyword, concat(p_name, '|', p_size) AS content_key
            FROM {part}""",
    }
)


def profiles(t):
    return t.profile.withColumns(
        {"primary_keywords": F.array("primary_keyword"), "secondary_keywords": F.array("secondary_keyword")}
    )


def issues(t):
    return t.issue.drop("brand")


def impact_settings(t):
    value = F.create_map(F.lit("business_relevance"), F.concat(F.lit("0."), (F.col("n_nationkey") % 4 + 1).cast("string")))
    return t.nation.filter("n_nationkey % 2 = 0").select(
        (F.col("n_nationkey") + 1).alias("site_id"), F.lit("impact_weights").alias("key"), value.alias("value")
    )


# ── SQL steps ────────────────────────────────────────────────────────────────
CTR_B = """CASE WHEN position IS NULL OR position <= 0 THEN 0 WHEN position >= 11 THEN greatest(0.002, 0.25 / position)
  WHEN position <= 1 THEN 0.28 WHEN position <= 2 THEN 0.15 WHEN position <= 3 THEN 0.11 WHEN position <= 4 THEN 0.08 WHEN position <= 5 THEN 0.06
  WHEN position <= 6 THEN 0.05 WHEN position <= 7 THEN 0.04 WHEN position <= 8 THEN 0.03 WHEN position <= 9 THEN 0.028 ELSE 0.025 END"""
common(
    "impact_metric",
    f"""SELECT m.*, sum(revenue) OVER (PARTITION BY site_id) AS site_revenue, sum(conversions) OVER (PARTITION BY site_id) AS site_conversions,
          CAST({CTR_B} AS DOUBLE) AS target, CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END AS raw_ctr
        FROM {{page_metric}} m WHERE is_active""",
)
SEARCH_OPP = """CASE WHEN impressions <= 0 THEN 0.45 ELSE least(1.0, greatest(0.05, 0.40 * least(1.0, log10(impressions + 1) / 5)
   + 0.30 * CASE WHEN position IS NULL THEN 0.5 WHEN position <= 3 THEN 0.25 WHEN position <= 10 THEN 1 WHEN position <= 20 THEN 0.85 WHEN position <= 50 THEN 0.45 ELSE 0.2 END
   + 0.30 * CASE WHEN target > 0 AND impressions >= 50 THEN least(1.0, greatest(0.0, (target - raw_ctr) / target)) ELSE 0 END)) END"""
ACTIVITY_OPP = """CASE WHEN sessions <= 0 THEN 0.40 ELSE least(1.0, greatest(0.05, 0.40 * least(1.0, log10(sessions + 1) / 4)
   + 0.35 * CASE WHEN engagement_rate IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, (0.70 - engagement_rate) / 0.70)) END
   + 0.25 * CASE WHEN sessions >= 30 THEN least(1.0, greatest(0.0, (0.05 - conversions / sessions) / 0.05)) ELSE 0.5 END)) END"""
PATH_HIT = " WHEN ".join(f"contains(lower(path), '{p}') THEN '{p}'" for p in PATTERNS)
RELEVANCE = f"""CASE WHEN site_revenue > 0 AND revenue > 0 THEN least(1.0, greatest(0.05, sqrt(least(1.0, revenue / site_revenue * 8))))
   WHEN site_conversions > 0 AND conversions > 0 THEN least(1.0, greatest(0.05, sqrt(least(1.0, conversions / site_conversions * 8))))
   WHEN (CASE WHEN {PATH_HIT} END) IS NOT NULL THEN 0.85 ELSE 0.5 END"""
BASIS = f"""CASE WHEN site_revenue > 0 AND revenue > 0 THEN 'share of site revenue' WHEN site_conversions > 0 AND conversions > 0 THEN 'share of site conversions'
   WHEN (CASE WHEN {PATH_HIT} END) IS NOT NULL THEN concat('matched configured high-value path ''', CASE WHEN {PATH_HIT} END, '''') ELSE 'no revenue, conversion or configured signal — neutral' END"""


def confidence_sql(method: str) -> str:
    return f"""least(0.95, greatest(0.10, {r(f'''0.35 + CASE WHEN impressions <= 0 THEN 0 WHEN impressions >= 100 THEN 0.25 ELSE 0.15 END
      + CASE WHEN sessions <= 0 THEN 0 WHEN sessions >= 100 THEN 0.20 ELSE 0.12 END + CASE WHEN impressions > 0 AND sessions > 0 THEN 0.10 ELSE 0 END
      + CASE {method} WHEN 'ai' THEN 0.05 WHEN 'rules' THEN -0.05 ELSE 0 END''', 3)}))"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


common("catalogue", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(k)}, {q(l)}, {s}::DOUBLE, {a}::DOUBLE, {c}::DOUBLE, {q(e)}, {q(m)})" for k, l, s, a, c, e, m in rows()
) + ") AS c(check_type, label, search_leverage, activity_leverage, ceiling, effort, mechanism)")

PCT = lambda x: f"concat(format('{{:.1f}}', {r(f'100 * ({x})', 1)}), '%')"
NUM = lambda x: f"format('{{:,}}', CAST(floor({x}) AS BIGINT))"
POS = "format('{:.1f}', position)"
INT0 = lambda x: f"format('{{:.0f}}', round_even({x}, 0))"
T4, C4 = r("target", 4), r("raw_ctr", 4)
REASON = f"""concat_ws(' ', CASE WHEN impressions >= 50 AND position IS NOT NULL THEN concat('This URL receives ', {NUM('impressions')}, ' impressions at average position ', {POS},
      CASE WHEN {T4} > 0 AND {C4} < {T4} THEN concat(', with a ', {PCT(C4)}, ' click-through rate against the ', {PCT(T4)}, ' typical for that position') ELSE '' END, '.')
    WHEN impressions > 0 THEN concat('This URL receives ', {NUM('impressions')}, ' search impressions.') ELSE 'This URL has no search impressions recorded in the current window.' END,
  CASE WHEN sessions > 0 THEN concat('It draws ', {NUM('sessions')}, ' sessions', CASE WHEN engagement_rate IS NOT NULL THEN concat(' at a ', {INT0(f"100 * {r('engagement_rate', 6)}")}, '% engagement rate.') ELSE '.' END) END,
  concat('Fixing this matters because ', mechanism, '.'), CASE WHEN NOT contains({BASIS}, 'no revenue') THEN concat('Business weighting: ', {BASIS}, '.') END)"""
_gap = r("CASE WHEN target > 0 AND impressions >= 50 THEN least(1.0, greatest(0.0, (target - raw_ctr) / target)) ELSE 0 END", 3)
_rec = f"floor({r(f'impressions * ({T4} - {C4})', 6)})"
OUTCOME = f"""CASE WHEN {_gap} > 0.25 AND impressions >= 100 AND {_rec} > 0 THEN concat('Closing the click-through gap at the current ranking would be worth roughly ', {NUM(_rec)},
      ' additional clicks per window if the snippet performs to the position average. Not guaranteed — ranking and SERP layout can shift.')
  ELSE concat('Expected to improve ', CASE WHEN search_impact_score >= user_activity_score THEN 'search performance' ELSE 'on-site user activity' END, ' for this URL. Search impact ', {INT0('search_impact_score')},
      '/100, user activity impact ', {INT0('user_activity_score')}, '/100. SEO outcomes cannot be guaranteed; treat this as a ranked expectation, not a promise.') END"""

common(
    "candidate",
    f"""SELECT page_id, check_type, severity, 'rules' AS method, issue_id, description AS current_state FROM {{issue}} WHERE NOT is_resolved
        UNION ALL SELECT page_id, 'search_intent_mismatch', CASE mismatch_severity WHEN 'P0' THEN 'CRITICAL' WHEN 'P1' THEN 'HIGH' WHEN 'P2' THEN 'MEDIUM' ELSE 'HIGH' END, 'statistical', NULL, mismatch_explanation
          FROM {{profile}} WHERE intent_mismatch
        UNION ALL SELECT page_id, 'ctr_opportunity', CASE WHEN raw_ctr < 0.4 * target THEN 'HIGH' ELSE 'MEDIUM' END, 'statistical', NULL,
          concat({PCT('raw_ctr')}, ' CTR at position ', {POS}, ' against a ', {PCT('target')}, ' expectation')
          FROM {{impact_metric}} WHERE impressions >= 200 AND position IS NOT NULL AND target > 0 AND raw_ctr < 0.75 * target""",
)


def geo(parts: dict[str, str], business: str = "w_business") -> str:
    w = {"search": "0.28", "activity": "0.22", "potential": "0.25", "relevance": business, "conf": "0.10"}
    total = " + ".join(w.values())
    logs = " + ".join(f"{w[k]} * ln(greatest({parts[k]}, 0.05))" for k in w)
    return r(f"100 * exp(({logs}) / ({total}))", 1)


_base = {k: k for k in ("search", "activity", "potential", "relevance", "conf")}
_lev = lambda lev: f"least(1.0, greatest(0.05, potential * (0.35 + 0.65 * {lev})))"
common(
    "factor",
    f"""SELECT f.*, m.site_id, m.path, m.clicks, m.impressions, m.position, m.sessions, m.conversions, m.revenue, m.engagement_rate, m.site_revenue, m.site_conversions, m.target, m.raw_ctr,
          coalesce(c.label, '{DEFAULT_TYPE[1]}') AS label, CASE WHEN c.label IS NULL THEN 'other' ELSE f.check_type END AS recommendation_type,
          coalesce(c.search_leverage, 0.5) AS search_leverage, coalesce(c.activity_leverage, 0.5) AS activity_leverage, coalesce(c.effort, 'medium') AS effort,
          coalesce(c.mechanism, '{DEFAULT_TYPE[6]}') AS mechanism, coalesce(c.ceiling, 0.5) AS ceiling,
          CAST({SEARCH_OPP} AS DOUBLE) AS search, CAST({ACTIVITY_OPP} AS DOUBLE) AS activity, CAST({RELEVANCE} AS DOUBLE) AS relevance, {confidence_sql('f.method')} AS conf,
          CAST(least(1.0, greatest(0.05, coalesce(c.ceiling, 0.5) * CASE f.severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.55 WHEN 'LOW' THEN 0.3 ELSE 0.55 END)) AS DOUBLE) AS potential,
          CAST(coalesce(CASE WHEN n.n_nationkey % 2 = 0 THEN (n.n_nationkey % 4 + 1) / 10.0 END, 0.15) AS DOUBLE) AS w_business
        FROM {{candidate}} f JOIN {{impact_metric}} m ON m.page_id = f.page_id LEFT JOIN {{catalogue}} c ON c.check_type = f.check_type
        LEFT JOIN nation n ON n.n_nationkey + 1 = m.site_id""",
)
common(
    "recommendation",
    f"""SELECT *, {REASON} AS reason, {OUTCOME} AS expected_outcome FROM (SELECT *, {geo({**_base, 'activity': '0.5', 'potential': _lev('search_leverage')})} AS search_impact_score,
          {geo({**_base, 'search': '0.5', 'potential': _lev('activity_leverage')})} AS user_activity_score, {geo(_base, '0.45')} AS business_impact_score, {geo(_base)} AS overall_priority FROM {{factor}})""",
)
common(
    "recommendation_best",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overall_priority DESC, recommendation_type, issue_id NULLS LAST) AS page_rank FROM {recommendation}) WHERE page_rank <= 12""",
)
common(
    "impact_ranked",
    """SELECT p.page_id, p.site_id, p.highest_severity, b.impact_score, row_number() OVER (PARTITION BY p.site_id ORDER BY coalesce(b.impact_score, 0) DESC, p.page_id) AS rank,
         coalesce(f.intent_mismatch, FALSE) AS mismatch, coalesce(i.n, 0) AS open_issues
       FROM {page} p LEFT JOIN (SELECT page_id, max(overall_priority) AS impact_score FROM {recommendation_best} GROUP BY page_id) b ON b.page_id = p.page_id
       LEFT JOIN {profile} f ON f.page_id = p.page_id LEFT JOIN (SELECT page_id, count(*) AS n FROM {issue} WHERE NOT is_resolved GROUP BY page_id) i ON i.page_id = p.page_id WHERE p.is_active""",
)


def route_sql(issues_: str, critical: str, pages: int = 200) -> tuple[str, str]:
    s = "coalesce(impact_score, 0)"
    rungs = [
        (f"{issues_} = 0 AND NOT mismatch", "rules", "'no outstanding issues'"),
        ("rank <= 20 AND mismatch", "deep_ai", "'top 20 by impact with a confirmed intent mismatch'"),
        (f"rank <= 20 AND {s} >= 75", "deep_ai", f"concat('top 20 by impact (score ', {INT0(s)}, ' >= 75)')"),
        (f"rank <= {pages} AND {critical} AND {s} < 45", "ai", "'carries a CRITICAL issue'"),
        (f"rank <= {pages} AND {s} >= 45", "ai", f"concat('impact ', {INT0(s)}, ' >= 45 and inside the top {pages}')"),
        (f"rank > {pages}", "statistical", f"'outside the top {pages} pages by impact'"),
        ("TRUE", "statistical", f"concat('impact ', {INT0(s)}, ' below the AI threshold of 45')"),
    ]
    tier = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in rungs) + " END"
    why = "CASE " + " ".join(f"WHEN {c} THEN {w}" for c, _, w in rungs) + " END"
    return tier, why


_tier, _why = route_sql("open_issues", "highest_severity = 'CRITICAL'")
common("routed", f"SELECT *, {_tier} AS page_tier, {_why} AS tier_reason FROM {{impact_ranked}}")
DET = ", ".join(q(x) for x in tiering.DETERMINISTIC)
CTX = ", ".join(q(x) for x in tiering.CONTEXTUAL)
FINDING_TIER = f"""CASE WHEN recommendation_type IN ({DET}) THEN 'rules' WHEN page_tier NOT IN ('ai', 'deep_ai') THEN 'statistical'
   WHEN recommendation_type IN ({CTX}) AND page_tier = 'deep_ai' AND overall_priority >= 75 THEN 'deep_ai' WHEN recommendation_type IN ({CTX}) THEN 'ai' ELSE 'statistical' END"""
LEVELS = [
    ("issue_severity = 'CRITICAL' AND recommendation_type IN ('http_status', 'robots', 'canonical_target')", "P0", "'page cannot be indexed or served correctly'"),
    ("mismatch_severity = 'P0'", "P0", "'major search intent mismatch'"),
    ("impressions >= 1000 AND position > 10", "P0", f"concat('high-demand page ranking at position ', {INT0('position')})"),
    ("issue_severity = 'CRITICAL'", "P0", "'severe technical issue'"),
    ("impressions >= 1000 AND raw_ctr < 0.01", "P0", f"concat({NUM('impressions')}, ' impressions at ', {PCT('raw_ctr')}, ' CTR')"),
    ("overall_priority >= 70", "P1", "'strong opportunity for growth'"),
    ("overall_priority >= 45", "P2", "'useful optimisation with lower expected impact'"),
    ("TRUE", "P3", "'minor improvement'"),
]
LEVEL = "CASE " + " ".join(f"WHEN {c} THEN '{l}'" for c, l, _ in LEVELS) + " END"
LEVEL_WHY = "CASE " + " ".join(f"WHEN {c} THEN {w}" for c, _, w in LEVELS) + " END"
common(
    "recommendation_out",
    f"""SELECT *, {LEVEL} AS priority_level, {LEVEL_WHY} AS level_reason, {FINDING_TIER} AS tier FROM (
          SELECT b.*, CASE WHEN b.issue_id IS NOT NULL THEN b.severity END AS issue_severity, r.rank AS impact_rank, r.page_tier, f.mismatch_severity, f.primary_keyword, f.detected_intent AS search_intent
          FROM {{recommendation_best}} b JOIN {{routed}} r ON r.page_id = b.page_id LEFT JOIN {{profile}} f ON f.page_id = b.page_id)""",
)


# ── Spark side ───────────────────────────────────────────────────────────────
def active(t):
    return plan.with_site_totals(page_metrics(t).filter("is_active"))


def weights(t):
    return plan.impact_weights(t.page, impact_settings(t))


def found(t):
    a = active(t)
    facts = a.select("page_id", "site_id", "path", "site_revenue", "site_conversions", *plan.METRICS)
    return plan.candidates(a, issues(t), profiles(t)).join(facts, "page_id")


def scored(t):
    return plan.scored_findings(active(t), issues(t), profiles(t), weights(t), PATTERNS)


def recommendations(t):
    return plan.recommendation_scores(page_metrics(t), issues(t), profiles(t), weights(t), PATTERNS)


OUT = """site_id, page_id, recommendation_type, title, current_state, primary_keyword, search_intent, search_impact_score, user_activity_score, business_impact_score,
  overall_priority, confidence_score, priority_level, severity, effort, reason, expected_outcome, tier, page_rank, impact_rank, issue_id"""


@query(
    "pipe05_recommendation_scores",
    """SELECT site_id, page_id, recommendation_type, label AS title, current_state, primary_keyword, search_intent, search_impact_score, user_activity_score, business_impact_score,
         overall_priority, conf AS confidence_score, priority_level, issue_severity AS severity, effort, concat(reason, ' Priority ', priority_level, ': ', level_reason, '.') AS reason,
         expected_outcome, tier, page_rank, impact_rank, issue_id FROM {recommendation_out}""",
)
def _(t):
    return recommendations(t).select(*[c.strip() for c in OUT.split(",")])


@query("scl25_expected_ctr_by_position", f"SELECT row_id, {r(CTR_B, 6)} AS expected_ctr FROM {{gsc_raw}}")
def _(t):
    return t.gsc_raw.select("row_id", rnd(fx.expected_ctr("position"), 6).alias("expected_ctr"))


def _factor_query(key, sql, column):
    @query(key, f"SELECT page_id, {r(sql, 6)} AS value FROM {{impact_metric}}")
    def _(t):
        return active(t).select("page_id", rnd(column(), 6).alias("value"))


_factor_query("scl28_search_opportunity", SEARCH_OPP, fx.search_opportunity)
_factor_query("scl29_activity_opportunity", ACTIVITY_OPP, fx.activity_opportunity)
_factor_query("scl31_business_relevance", RELEVANCE, lambda: fx.business_relevance(patterns=PATTERNS))
_factor_query("scl32_confidence", confidence_sql("'statistical'"), fx.data_confidence)


@query("scl30_improvement_potential", f"SELECT issue_id, {r('potential', 6)} AS potential FROM {{factor}} WHERE issue_id IS NOT NULL")
def _(t):
    rows_ = with_catalogue(issues(t).filter("not is_resolved").join(t.page.filter("is_active").select("page_id"), "page_id"))
    return rows_.select("issue_id", rnd(fx.improvement_potential("ceiling", "severity"), 6).alias("potential"))


@query("scl33_geometric_mean", f"SELECT page_id, check_type, issue_id, {geo(_base, '0.15')} AS mean FROM {{factor}}")
def _(t):
    rows_ = with_catalogue(found(t)).withColumns(plan.factor_columns(PATTERNS))
    w = {k: F.lit(v) for k, v in fx.FACTOR_WEIGHTS.items()}
    mean = rnd(100.0 * fx.geometric_mean({k: F.col(k) for k in w}, w), 1)
    return rows_.select("page_id", "check_type", "issue_id", mean.alias("mean"))


@query(
    "scl34_recommendation_scores",
    "SELECT page_id, recommendation_type, issue_id, search_impact_score, user_activity_score, business_impact_score, overall_priority, conf AS confidence_score FROM {recommendation}",
)
def _(t):
    return scored(t).select(
        "page_id", "recommendation_type", "issue_id", "search_impact_score", "user_activity_score", "business_impact_score",
        "overall_priority", "confidence_score",
    )


@query("scl35_reason_and_outcome", "SELECT page_id, recommendation_type, issue_id, reason, expected_outcome FROM {recommendation}")
def _(t):
    return scored(t).select("page_id", "recommendation_type", "issue_id", "reason", "expected_outcome")


@query("scl36_priority_level", "SELECT page_id, recommendation_type, page_rank, priority_level, level_reason FROM {recommendation_out}")
def _(t):
    best = plan.best_per_page(scored(t)).join(profiles(t).select("page_id", "mismatch_severity"), "page_id", "left")
    level, why = fx.priority_level(
        "overall_priority", "recommendation_type", F.when(F.col("issue_id").isNotNull(), F.col("severity")), "mismatch_severity"
    )
    return best.select("page_id", "recommendation_type", "page_rank", level.alias("priority_level"), why.alias("level_reason"))


@query("scl37_ctr_opportunity", "SELECT page_id, severity, current_state FROM {candidate} WHERE check_type = 'ctr_opportunity'")
def _(t):
    rows_ = plan.candidates(active(t), issues(t), profiles(t)).filter("check_type = 'ctr_opportunity'")
    return rows_.select("page_id", "severity", "current_state")


_unit = lambda e: r(f"CASE WHEN {e} IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, {e})) END", 4)
TRAFFIC = r(
    f"100 * (0.65 * {r(SEARCH_OPP, 4)} + 0.20 * {_unit('keyword_opportunity_score / 100')} + 0.10 * {_unit('intent_confidence')} + 0.05 * {_unit('seo_score / 100')})", 1
)
LIKELY = "CASE detected_intent WHEN 'transactional' THEN 1.0 WHEN 'commercial' THEN 0.9 WHEN 'local' THEN 0.65 WHEN 'navigational' THEN 0.55 WHEN 'informational' THEN 0.3 ELSE 0.5 END"
LEAD = r(
    f"""100 * (0.30 * {r(f'least(1.0, greatest(0.0, 0.65 * {RELEVANCE} + 0.35 * {LIKELY}))', 4)} + 0.25 * {r('least(1.0, greatest(0.0, traffic_potential_score / 100))', 4)}
      + 0.25 * {r('CASE WHEN sessions >= 30 THEN least(1.0, greatest(0.0, conversions / sessions / 0.05)) ELSE 0.5 END', 4)} + 0.20 * {_unit('engagement_rate')})""",
    1,
)
common(
    "potential",
    f"""SELECT *, {LEAD} AS lead_potential_score FROM (SELECT *, {TRAFFIC} AS traffic_potential_score FROM (
          SELECT m.*, f.keyword_opportunity_score, f.intent_confidence, f.detected_intent FROM {{impact_metric}} m LEFT JOIN {{profile}} f ON f.page_id = m.page_id))""",
)


@query("pipe12_opportunity_backfill", "SELECT site_id, page_id, traffic_potential_score, lead_potential_score FROM {potential}")
def _(t):
    return plan.opportunity_backfill(page_metrics(t), profiles(t), PATTERNS)


@query("scl38_traffic_potential", "SELECT page_id, traffic_potential_score FROM {potential}")
def _(t):
    rows_ = active(t).join(profiles(t).drop("site_id"), "page_id", "left")
    return rows_.select("page_id", fx.traffic_potential().alias("traffic_potential_score"))


@query("scl39_lead_potential", "SELECT page_id, lead_potential_score FROM {potential}")
def _(t):
    rows_ = active(t).join(profiles(t).drop("site_id"), "page_id", "left").withColumn("traffic_potential_score", fx.traffic_potential())
    return rows_.select("page_id", fx.lead_potential(patterns=PATTERNS).alias("lead_potential_score"))


@query(
    "agg15_site_totals",
    f"SELECT DISTINCT site_id, {r('site_revenue', 2)} AS site_revenue, {r('site_conversions', 2)} AS site_conversions FROM {{impact_metric}}",
)
def _(t):
    return active(t).groupBy("site_id").agg(rnd(F.max("site_revenue"), 2).alias("site_revenue"), rnd(F.max("site_conversions"), 2).alias("site_conversions"))


@query("top08_best_recommendations", "SELECT page_id, page_rank, recommendation_type, issue_id, overall_priority FROM {recommendation_best}")
def _(t):
    return plan.best_per_page(scored(t)).select("page_id", "page_rank", "recommendation_type", "issue_id", "overall_priority")


@query("win05_impact_rank", "SELECT page_id, impact_score, rank FROM {impact_ranked}")
def _(t):
    best = plan.best_per_page(scored(t))
    return plan.impact_rank(t.page.filter("is_active"), best).select("page_id", "impact_score", "rank")


@query("pipe06_tier_routing", "SELECT page_id, rank, impact_score, page_tier, tier_reason FROM {routed}")
def _(t):
    ranked = plan.impact_rank(t.page.filter("is_active"), plan.best_per_page(scored(t)))
    return plan.routed_pages(ranked, issues(t), profiles(t)).select("page_id", "rank", "impact_score", "page_tier", "tier_reason")


@query(
    "agg21_tier_counts",
    """SELECT site_id, count(*) FILTER (WHERE page_tier = 'rules') AS rules, count(*) FILTER (WHERE page_tier = 'statistical') AS statistical, count(*) FILTER (WHERE page_tier = 'ai') AS ai,
         count(*) FILTER (WHERE page_tier = 'deep_ai') AS deep_ai, count(*) FILTER (WHERE page_tier IN ('ai', 'deep_ai')) AS ai_calls FROM {routed} GROUP BY site_id""",
)
def _(t):
    ranked = plan.impact_rank(t.page.filter("is_active"), plan.best_per_page(scored(t)))
    return plan.tier_counts(plan.routed_pages(ranked, issues(t), profiles(t)))


# Selection reads stored scores: rows derived from lineitem stand for them (every fourth site has none).
VIEWS["stored_score"] = """
    SELECT l_orderkey * 10 + l_linenumber AS score_id, l_partkey AS page_id, CAST(substr(p_brand, 7) AS INT) AS site_id,
           split_part('title,content,image_alt,h1,canonical,ctr_opportunity,search_intent_mismatch', ',', CAST(l_linenumber AS INT)) AS recommendation_type,
           CAST((l_suppkey * 7 + l_orderkey) % 1000 AS DOUBLE) / 10 AS overall_priority,
           CAST((l_suppkey * 11 + l_orderkey) % 1000 AS DOUBLE) / 10 AS search_impact_score,
           CAST((l_suppkey * 13 + l_orderkey) % 1000 AS DOUBLE) / 10 AS user_activity_score,
           CAST((l_suppkey * 17 + l_orderkey) % 1000 AS DOUBLE) / 10 AS business_impact_score,
           split_part('P0,P1,P2,P3', ',', CAST(1 + l_orderkey % 4 AS INT)) AS priority_level,
           split_part('low,medium,high', ',', CAST(1 + l_orderkey % 3 AS INT)) AS effort,
           split_part('detected,approved,implemented,dismissed', ',', CAST(1 + l_suppkey % 4 AS INT)) AS status,
           concat('reason ', l_suppkey) AS reason
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

LIMIT = 15
_stier, _swhy = route_sql("coalesce(issue_count, 0)", "highest_severity = 'CRITICAL'", LIMIT)
common(
    "select_ranked",
    """SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN have THEN coalesce(impact_score, 0) ELSE coalesce(priority_score, 0) END DESC, coalesce(seo_score, 0), page_id) AS rank FROM (
         SELECT p.*, b.impact_score, coalesce(f.intent_mismatch, FALSE) AS mismatch, max(CASE WHEN b.impact_score IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.site_id) = 1 AS have
         FROM {page} p LEFT JOIN (SELECT page_id, max(overall_priority) AS impact_score FROM {stored_score} GROUP BY page_id) b ON b.page_id = p.page_id
         LEFT JOIN {profile} f ON f.page_id = p.page_id WHERE p.is_active)""",
)
_idle = "coalesce(issue_count, 0) = 0 AND NOT mismatch"
_W = [
    ("seo_score IS NULL", "FALSE", "'rules'", "'not audited yet'"),
    (_idle, "FALSE", "'rules'", "'no outstanding issues'"),
    ("impact_score IS NULL AND highest_severity = 'CRITICAL'", "TRUE", "'ai'", "'carries a CRITICAL issue'"),
    ("impact_score IS NULL AND seo_score > 80", "FALSE", "'statistical'", "concat('healthy (SEO ', CAST(seo_score AS VARCHAR), ' > 80.0)')"),
    ("impact_score IS NULL", "TRUE", "'ai'", "concat('SEO ', CAST(seo_score AS VARCHAR), ' is at or below the 80.0 threshold')"),
    ("t IN ('ai', 'deep_ai') AND seo_score > 80", "FALSE", "'statistical'", "concat('healthy (SEO ', CAST(seo_score AS VARCHAR), ' > 80.0)')"),
    ("TRUE", "t IN ('ai', 'deep_ai')", "t", "w"),
]
_case = lambda i: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[i]}" for x in _W) + " END"
common("select_wish", f"SELECT *, {_case(1)} AS s0, {_case(2)} AS t0, {_case(3)} AS w0 FROM (SELECT *, {_stier} AS t, {_swhy} AS w FROM {{select_ranked}})")
common(
    "selection",
    f"""SELECT site_id, page_id, rank, impact_score, CASE WHEN over THEN FALSE ELSE s0 END AS selected, CASE WHEN over THEN 'statistical' ELSE t0 END AS tier,
          CASE WHEN over THEN 'outside the top {LIMIT} pages by priority' ELSE w0 END AS reason FROM (
          SELECT *, seo_score IS NOT NULL AND NOT ({_idle}) AND coalesce(sum(CASE WHEN s0 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {LIMIT} AS over
          FROM {{select_wish}})""",
)


def selection(t):
    return plan.selection_preview(t.page, t.stored_score, profiles(t), limit=LIMIT, threshold=80.0)


@query("pipe07_selection_preview", "SELECT * FROM {selection}")
def _(t):
    return selection(t)


@query("win08_model_call_budget", "SELECT site_id, page_id, rank FROM {selection} WHERE selected")
def _(t):
    return selection(t).filter("selected").select("site_id", "page_id", "rank")


VIEWS["stored_finding"] = """
    SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey AS page_id, CASE WHEN l_returnflag = 'A' THEN 'failed' ELSE 'completed' END AS status,
           concat(p_name, '|', CASE WHEN l_suppkey % 2 = 0 THEN p_size ELSE p_size + 1 END) AS content_key, concat('payload ', l_suppkey) AS payload
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


@query(
    "pipe08_reusable_finding",
    """SELECT page_id, finding_id, payload FROM (SELECT p.page_id, f.finding_id, f.payload, row_number() OVER (PARTITION BY p.page_id ORDER BY f.finding_id DESC) AS rn
         FROM {page} p JOIN {stored_finding} f ON f.page_id = p.page_id AND f.content_key = p.content_key WHERE f.status = 'completed') WHERE rn = 1""",
)
def _(t):
    pages = t.page.withColumn("content_hash", F.sha2("content_key", 256))
    findings = t.stored_finding.withColumn("content_hash", F.sha2("content_key", 256))
    return plan.reusable_findings(pages, findings).select("page_id", "finding_id", "payload")


@query(
    "cat01_recommendation_catalogue",
    """SELECT i.check_type, coalesce(c.label, 'Other improvement') AS label, coalesce(c.ceiling, 0.5) AS ceiling, coalesce(c.effort, 'medium') AS effort, count(*) AS n
       FROM {issue} i LEFT JOIN {catalogue} c ON c.check_type = i.check_type GROUP BY ALL""",
)
def _(t):
    return with_catalogue(issues(t)).groupBy("check_type", "label", "ceiling", "effort").agg(F.count(F.lit(1)).alias("n"))
