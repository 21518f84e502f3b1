"""Priority components, weights, ranks, bands and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteledger.functions import priority as pf
from siteledger.functions.numeric import health_category, rnd, technical_band
from siteledger.operators import metrics, ranking
from siteledger.plans import priority as plan

from siteledger.session import checkpoint_dir, cut

from .q_facts import page_metrics
from .registry import common, query, r
from .views import TODAY

COMPONENTS = plan.COMPONENTS

SEVERITY_RAW = r(
    """0.55 * CASE highest_severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 0.72 WHEN 'MEDIUM' THEN 0.4 WHEN 'LOW' THEN 0.15 ELSE 0 END
       + 0.35 * coalesce((100 - seo_score) / 100, 0.5) + 0.10 * least(1.0, coalesce(issue_count, 0) / 12.0)""",
    6,
)
ACTIVITY_RAW = r("0.35 * ln(1 + users) + 0.15 * ln(1 + sessions) + 0.30 * 2 * ln(1 + conversions) + 0.20 * ln(1 + revenue)", 6)
CTR_A = """CASE WHEN position IS NULL OR position <= 0 THEN 0 ELSE CASE CAST(round_even(position, 0) AS INTEGER)
    WHEN 1 THEN 0.28 WHEN 2 THEN 0.15 WHEN 3 THEN 0.11 WHEN 4 THEN 0.08 WHEN 5 THEN 0.06 WHEN 6 THEN 0.05 WHEN 7 THEN 0.04 WHEN 8 THEN 0.03
    WHEN 9 THEN 0.026 WHEN 10 THEN 0.023 ELSE CASE WHEN round_even(position, 0) <= 20 THEN 0.015 ELSE 0.005 END END END"""


def gap_sql(floor: int) -> str:
    return f"CASE WHEN impressions >= {floor} AND ctr IS NOT NULL AND ({CTR_A}) > 0 AND ctr < ({CTR_A}) THEN least(1.0, (({CTR_A}) - ctr) / ({CTR_A})) ELSE 0 END"


SEARCH_RAW = r(
    f"""0.45 * ln(1 + clicks) + 0.30 * ln(1 + impressions) + 0.15 * 5 * CASE WHEN position IS NULL OR position <= 0 THEN 0
        WHEN position BETWEEN 4 AND 20 THEN 1 WHEN position < 4 THEN 0.35 ELSE greatest(0, 1 - (position - 20) / 60) * 0.5 END + 0.10 * 5 * {gap_sql(100)}""",
    6,
)
OPPORTUNITY_RAW = r(
    "0.30 * ln(1 + organic_keywords) + 0.25 * ln(1 + organic_traffic) + 0.30 * ln(1 + opportunity_volume) + 0.15 * ln(1 + backlinks)", 6
)

common(
    "raw_component",
    f"""SELECT *, {SEVERITY_RAW} AS seo_severity_raw, {ACTIVITY_RAW} AS ga4_activity_raw, {SEARCH_RAW} AS gsc_search_raw,
               {OPPORTUNITY_RAW} AS semrush_opportunity_raw FROM {{page_metric}}""",
)
common(
    "source_flag",
    """SELECT s.site_id, s.site_id IN (SELECT site_id FROM {gsc_raw}) AS has_gsc, s.site_id IN (SELECT site_id FROM {ga4_raw}) AS has_ga4,
              s.site_id IN (SELECT site_id FROM {semrush}) AS has_semrush FROM {site} s""",
)
_DEFAULT = {"seo_severity": "0.4", "ga4_activity": "0.3", "gsc_search": "0.2", "semrush_opportunity": "0.1"}
_HAS = {"seo_severity": "TRUE", "ga4_activity": "has_ga4", "gsc_search": "has_gsc", "semrush_opportunity": "has_semrush"}
_overlay = ", ".join(
    f"greatest(0, coalesce(try_cast(l.{c} AS DOUBLE), try_cast(g.{c} AS DOUBLE), {d})) AS {c}" for c, d in _DEFAULT.items()
)


def _norm(columns: dict[str, str]) -> str:
    total = " + ".join(columns.values())
    return ", ".join(f"CASE WHEN ({total}) > 0 THEN {r(f'{x} / ({total})', 6)} ELSE {_DEFAULT[c]} END AS {c}" for c, x in columns.items())


common(
    "site_weight",
    f"""SELECT site_id, {_norm({c: c for c in _DEFAULT})} FROM (SELECT s.site_id, {_overlay} FROM {{site}} s
        LEFT JOIN (SELECT * FROM {{setting_flat}} WHERE site_id IS NULL) g ON TRUE LEFT JOIN {{setting_flat}} l ON l.site_id = s.site_id)""",
)
common(
    "effective_weight",
    f"SELECT site_id, {_norm({c: f'(CASE WHEN {_HAS[c]} THEN {c} ELSE 0 END)' for c in _DEFAULT})} FROM {{site_weight}} JOIN {{source_flag}} USING (site_id)",
)


def bands_sql(source: str, score: str = "score") -> str:
    return f"""SELECT x.*, CASE WHEN n < 8 THEN CASE WHEN {score} >= 70 THEN 'P0' WHEN {score} >= 50 THEN 'P1' WHEN {score} >= 30 THEN 'P2' ELSE 'P3' END
        WHEN {score} >= list_extract(o, greatest(1, CAST(floor(n * 0.05::DOUBLE) AS INTEGER))) THEN 'P0' WHEN {score} >= list_extract(o, greatest(1, CAST(floor(n * 0.20::DOUBLE) AS INTEGER))) THEN 'P1'
        WHEN {score} >= list_extract(o, greatest(1, CAST(floor(n * 0.50::DOUBLE) AS INTEGER))) THEN 'P2' ELSE 'P3' END AS band
      FROM {source} x JOIN (SELECT site_id, count(*) AS n, list({score} ORDER BY {score} DESC) AS o FROM {source} GROUP BY site_id) USING (site_id)"""


def scored_sql(weights: str) -> str:
    parts = ", ".join(
        f"{r(f'percent_rank() OVER (PARTITION BY site_id ORDER BY {c}_raw)', 6)} AS {c}_component" for c in COMPONENTS
    )
    blend = " + ".join(f"w.{c} * y.{c}_component" for c in COMPONENTS)
    return f"""SELECT y.*, {r(f'100 * ({blend})', 2)} AS score FROM (SELECT *, {parts} FROM {{raw_component}} WHERE is_active) y
               JOIN {weights} w USING (site_id)"""


common("scored", scored_sql("{effective_weight}"))
common("banded", bands_sql("{scored}"))
common(
    "priority",
    "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, page_id) AS rank FROM {banded}",
)


def settings(t):
    entries = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in COMPONENTS]), lambda e: e["v"].isNotNull()
        )
    )
    return t.setting_flat.select("site_id", F.lit("priority_weights").alias("key"), entries.alias("value"))


def sources(t):
    return metrics.available_sources(t.gsc_raw, t.ga4_raw, t.semrush)


def weights(t):
    return plan.site_weights(t.page, settings(t), sources(t))


def priority(t, m=None):
    return plan.page_priority(page_metrics(t) if m is None else m, weights(t))


OUT = "site_id, page_id, score, band, rank, " + ", ".join(f"{c}_component" for c in COMPONENTS)


@query("pipe02_page_priority", f"SELECT {OUT} FROM {{priority}}")
def _(t):
    return priority(t).select(*[c.strip() for c in OUT.split(",")])


@query("scl20_severity_component", "SELECT page_id, seo_severity_raw FROM {raw_component}")
def _(t):
    return t.page.select("page_id", pf.seo_severity_raw("highest_severity", "seo_score", "issue_count").alias("seo_severity_raw"))


@query("scl21_activity_component", "SELECT page_id, ga4_activity_raw FROM {raw_component}")
def _(t):
    return page_metrics(t).select("page_id", pf.ga4_activity_raw().alias("ga4_activity_raw"))


@query("scl22_search_component", "SELECT page_id, gsc_search_raw FROM {raw_component}")
def _(t):
    return page_metrics(t).select("page_id", pf.gsc_search_raw().alias("gsc_search_raw"))


@query("scl23_opportunity_component", "SELECT page_id, semrush_opportunity_raw FROM {raw_component}")
def _(t):
    return page_metrics(t).select("page_id", pf.semrush_opportunity_raw().alias("semrush_opportunity_raw"))


@query("scl24_expected_ctr_by_rank", f"SELECT row_id, {r(CTR_A, 6)} AS expected_ctr FROM {{gsc_raw}}")
def _(t):
    return t.gsc_raw.select("row_id", rnd(pf.expected_ctr_by_rank("position"), 6).alias("expected_ctr"))


@query("scl26_redistributed_weights", "SELECT * FROM {effective_weight}")
def _(t):
    return weights(t)


SEARCH_IMPACT = f"""CASE WHEN clicks = 0 AND impressions = 0 AND coalesce(position, 0) = 0 THEN 50 ELSE
  {r(f'''least(100, greatest(10, 100 * (0.45 * {gap_sql(50)} + 0.35 * CASE WHEN position IS NULL OR position <= 0 THEN 0.3 WHEN position BETWEEN 4 AND 20 THEN 1 - (position - 4) / 25
     WHEN position < 4 THEN 0.5 ELSE greatest(0.1, 1 - position / 100) END + 0.20 * least(1.0, ln(1 + impressions) / ln(10001)))))''', 1)} END"""
ACTIVITY_IMPACT = f"""CASE WHEN users = 0 AND sessions = 0 AND conversions = 0 AND revenue = 0 THEN 50 ELSE
  {r('''least(100, greatest(10, 100 * (0.35 * least(1.0, ln(1 + sessions) / ln(5001)) + 0.35 * least(1.0, ln(1 + conversions) / ln(101))
     + 0.15 * least(1.0, ln(1 + revenue) / ln(1001)) + 0.15 * coalesce(least(1.0, greatest(0.0, engagement_rate)), 0.5))))''', 1)} END"""


@query(
    "scl27_fallback_impact",
    f"""SELECT page_id, CAST(s AS DOUBLE) AS search_impact, CAST(a AS DOUBLE) AS user_activity, {r('least(100, (0.55 * s + 0.45 * a) * (0.5 + 0.5 * 0.75))', 1)} AS impact
        FROM (SELECT page_id, {SEARCH_IMPACT} AS s, {ACTIVITY_IMPACT} AS a FROM {{page_metric}})""",
)
def _(t):
    scored = page_metrics(t).select(
        "page_id", pf.search_impact_score().alias("search_impact"), pf.user_activity_score().alias("user_activity")
    )
    blend = pf.combined_impact("search_impact", "user_activity", F.lit(0.75))
    return scored.withColumn("impact", rnd(F.least(F.lit(100.0), blend), 1))


@query(
    "win01_percent_rank",
    f"SELECT page_id, {r('percent_rank() OVER (PARTITION BY site_id ORDER BY impressions)', 8)} AS impressions_rank FROM {{page_metric}}",
)
def _(t):
    m = page_metrics(t).select("site_id", "page_id", "impressions")
    return ranking.percent_ranks(m, ["site_id"], {"impressions": "impressions_rank"}).select(
        "page_id", rnd("impressions_rank", 8).alias("impressions_rank")
    )


common("priority_known", "SELECT site_id, page_id, priority_score AS score FROM {page} WHERE priority_score IS NOT NULL")


@query("win02_relative_band", f"SELECT page_id, score, band FROM ({bands_sql('{priority_known}')})")
def _(t):
    known = t.page.filter("priority_score is not null").select("site_id", "page_id", F.col("priority_score").alias("score"))
    return plan.band_and_rank(known).select("page_id", "score", "band")


@query(
    "win03_rank_in_site",
    "SELECT page_id, row_number() OVER (PARTITION BY site_id ORDER BY priority_score DESC NULLS LAST, page_id) AS rank FROM {page}",
)
def _(t):
    return ranking.row_numbers(t.page, ["site_id"], [F.col("priority_score").desc_nulls_last(), F.col("page_id").asc()], "rank").select("page_id", "rank")


@query("jn19_weight_overlay", "SELECT * FROM {site_weight}")
def _(t):
    return plan.site_weights(t.page, settings(t))


@query("set04_available_sources", "SELECT site_id, has_gsc, has_ga4, has_semrush FROM {source_flag}")
def _(t):
    return sources(t).join(t.site.select("site_id"), "site_id", "left_semi")  # there are rows of sites that are gone


_PREVIEW = {"ga4_activity": 0.6, "gsc_search": 0.0}
common(
    "preview_weight",
    "SELECT site_id, "
    + _norm({c: f"(CASE WHEN {_HAS[c]} THEN {c} ELSE 0 END)" for c in _DEFAULT})
    + " FROM (SELECT site_id, has_gsc, has_ga4, has_semrush, "
    + _norm({c: str(_PREVIEW.get(c, c)) for c in _DEFAULT})
    + " FROM {site_weight} JOIN {source_flag} USING (site_id))",
)
common("preview_scored", scored_sql("{preview_weight}"))


@query(
    "flt11_score_preview",
    f"""SELECT site_id, page_id, score, band, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, page_id) AS rank
        FROM ({bands_sql('{preview_scored}')})) WHERE rank <= 20""",
)
def _(t):
    configured = plan.site_weights(t.page, settings(t))
    return plan.score_preview(page_metrics(t), configured, sources(t), _PREVIEW).select("site_id", "page_id", "score", "band", "rank")


@query(
    "scl44_category_and_band",
    """SELECT page_id, CASE WHEN seo_score > 90 THEN 'LOW ISSUES' WHEN seo_score >= 75 THEN 'MEDIUM ISSUES' WHEN seo_score IS NOT NULL THEN 'HIGH ISSUES' END AS category,
              CASE highest_severity WHEN 'CRITICAL' THEN 'P0' WHEN 'HIGH' THEN 'P1' WHEN 'MEDIUM' THEN 'P2' ELSE 'P3' END AS band FROM {page}""",
)
def _(t):
    return t.page.select("page_id", health_category("seo_score").alias("category"), technical_band("highest_severity").alias("band"))


@query(
    "snk04_score_history",
    f"""SELECT site_id, page_id, score, band, rank, DATE '{TODAY}' AS computed_date, seo_severity_raw AS raw_severity, impressions,
          concat(CASE WHEN has_ga4 THEN 'ga4,' ELSE '' END, CASE WHEN has_gsc THEN 'gsc,' ELSE '' END, CASE WHEN has_semrush THEN 'semrush,' ELSE '' END, 'seo') AS data_sources,
          w.seo_severity AS weight_seo_severity
        FROM {{priority}} JOIN {{source_flag}} USING (site_id) JOIN {{effective_weight}} w USING (site_id)""",
)
def _(t):
    m = cut(page_metrics(t))
    scored = cut(priority(t, m))
    folder = f"{checkpoint_dir(t.spark)}/history-{uuid.uuid4().hex}"
    for day in ("2001-01-01", TODAY):  # two runs are appended, the later one is read back by its partition
        plan.append_history(plan.score_history(scored, m, weights(t), sources(t), computed_date=day), folder)
    history = t.spark.read.parquet(folder).filter(F.col("computed_date") == F.lit(TODAY).cast("date"))
    return history.select(
        "site_id", "page_id", "score", "band", "rank", "computed_date",
        F.col("breakdown.raw.seo_severity").alias("raw_severity"), F.col("breakdown.metrics.impressions").cast("long").alias("impressions"),
        F.array_join("data_sources", ",").alias("data_sources"), F.col("weights.seo_severity").alias("weight_seo_severity"),
    )
