"""Lists, summaries, portfolio, roadmap, rollups, search results and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteledger.functions.numeric import rnd
from siteledger.operators import exports
from siteledger.plans import reports, rollup
from siteledger.plans import roadmap as rm
from siteledger.plans.audit import open_issues
from siteledger.session import checkpoint_dir, cut
from siteledger.sources import serp

from .q_facts import ga4, gsc, page_metrics, snapshots_with_keywords
from .q_impact import profiles
from .registry import common, query, r
from .views import TODAY, VIEWS



def since():
    return F.date_sub(F.to_date(F.lit(TODAY)), 90)


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
common("open_issue", "SELECT i.*, p.site_id AS sid, p.priority_score, p.url FROM {issue} i JOIN {page} p ON p.page_id = i.page_id WHERE p.is_active AND NOT i.is_resolved")
common("page_total", "SELECT p.*, m.users, m.sessions, m.conversions, m.revenue, m.clicks, m.impressions FROM {page} p JOIN {page_metric} m ON m.page_id = p.page_id")


def opened(t):
    return open_issues(t.issue, t.page)


def totals(t):
    return reports.metric_totals(t.page, gsc(t), ga4(t), since())


# ── filters, sorts, lists ────────────────────────────────────────────────────
@query(
    "flt01_page_filters",
    "SELECT page_id, url FROM {page} WHERE is_active AND (contains(lower(url), 'ring') OR contains(lower(title), 'ring')) AND seo_score >= 30 AND seo_score <= 90 AND status_code = 200 AND issue_count > 0",
)
def _(t):
    return reports.filter_pages(t.page, search=" RING ", min_seo_score=30, max_seo_score=90, status_code=200, has_issues=True).select("page_id", "url")


@query(
    "flt01_page_filters_by_band",
    "SELECT page_id, url FROM {page} p WHERE seo_category = 'HIGH ISSUES' AND highest_severity = 'HIGH' AND priority_band = 'P2' AND ai_status = 'completed' AND priority_score >= 55",
)
def _(t):
    return reports.filter_pages(
        t.page, include_inactive=True, seo_category="high issues", severity="high", priority_band="p2", ai_status="Completed", min_priority_score=55
    ).select("page_id", "url")


@query("jn04_pages_with_rule", "SELECT page_id FROM {page} WHERE page_id IN (SELECT page_id FROM {issue} WHERE rule_id = 'title' AND NOT is_resolved)")
def _(t):
    return reports.pages_with_rule(t.page, t.issue, "title").select("page_id")


@query("jn02_pages_with_metric_totals", f"SELECT page_id, users, sessions, {r('conversions', 2)} AS conversions, {r('revenue', 2)} AS revenue, clicks, impressions FROM {{page_total}}")
def _(t):
    return totals(t).select("page_id", "users", "sessions", rnd("conversions", 2).alias("conversions"), rnd("revenue", 2).alias("revenue"), "clicks", "impressions")


_URGENCY = "CASE highest_severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END"
_PAGE_ORDER = f"priority_score DESC NULLS LAST, clicks DESC, impressions DESC, users DESC, conversions DESC, {_URGENCY}, seo_score ASC NULLS FIRST, page_id"


@query("srt01_priority_table_order", f"SELECT page_id, priority_score FROM (SELECT *, row_number() OVER (ORDER BY {_PAGE_ORDER}) AS rn FROM {{page_total}}) WHERE rn BETWEEN 101 AND 300")
def _(t):
    return reports.page_of(totals(t), reports.page_order(), 200, 100)[0].select("page_id", "priority_score")


@query("srt01_metric_order", "SELECT page_id, impressions FROM (SELECT *, row_number() OVER (ORDER BY impressions ASC, page_id) AS rn FROM {page_total}) WHERE rn <= 900")
def _(t):
    return reports.page_of(totals(t), reports.page_order("impressions", False), 900)[0].select("page_id", "impressions")


@query("top02_result_page_and_total", f"SELECT page_id, (SELECT count(*) FROM {{page}} WHERE is_active) AS total FROM (SELECT *, row_number() OVER (ORDER BY {_PAGE_ORDER}) AS rn FROM {{page_total}} WHERE is_active) WHERE rn BETWEEN 901 AND 950")
def _(t):
    rows, total = reports.page_of(totals(t).filter("is_active"), reports.page_order(), 50, 900)
    return rows.select("page_id").join(F.broadcast(total), F.lit(True))


@query("top03_fix_first", "SELECT site_id, page_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority_score DESC, page_id) AS rn FROM {page} WHERE is_active AND priority_score IS NOT NULL) WHERE rn <= 20")
def _(t):
    return reports.fix_first(t.page).select("site_id", "page_id", "place")


@query(
    "top01_top_issues",
    f"SELECT page_id, string_agg(title, '|' ORDER BY rn) AS top_issues FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {RANK} DESC, issue_id) AS rn FROM {{issue}} WHERE NOT is_resolved) WHERE rn <= 3 GROUP BY page_id",
)
def _(t):
    return reports.top_issues(t.issue).select("page_id", F.array_join("top_issues", "|").alias("top_issues"))


@query("flt02_issue_list", "SELECT issue_id, page_id, priority_score FROM {open_issue} WHERE severity = 'CRITICAL' ORDER BY priority_score DESC NULLS LAST, issue_id LIMIT 500")
def _(t):
    return reports.issue_list(opened(t), severity="critical", limit=500).select("issue_id", "page_id", "priority_score")


@query("flt03_opportunity_list", "SELECT score_id, s.page_id, url, overall_priority FROM {stored_score} s JOIN {page} p ON p.page_id = s.page_id WHERE priority_level = 'P1' AND status = 'detected'")
def _(t):
    return reports.opportunity_list(t.stored_score, t.page, level="p1", status="detected").select("score_id", "page_id", "url", "overall_priority")


@query("flt03_opportunity_counts", """SELECT site_id, count(*) FILTER (WHERE priority_level = 'P0') AS "P0", count(*) FILTER (WHERE priority_level = 'P1') AS "P1", count(*) FILTER (WHERE priority_level = 'P2') AS "P2", count(*) FILTER (WHERE priority_level = 'P3') AS "P3" FROM {stored_score} GROUP BY site_id""")
def _(t):
    return reports.opportunity_counts(t.stored_score)


@query("flt04_mismatch_list", "SELECT f.page_id, mismatch_severity, keyword_opportunity_score FROM {profile} f JOIN {page} p ON p.page_id = f.page_id WHERE intent_mismatch ORDER BY mismatch_severity, coalesce(keyword_opportunity_score, 0) DESC, f.page_id LIMIT 100")
def _(t):
    return reports.mismatch_list(profiles(t), t.page, limit=100).select("page_id", "mismatch_severity", "keyword_opportunity_score")


@query("flt05_site_search", "SELECT site_id, name FROM {site} WHERE (contains(lower(name), 'site 1') OR contains(domain, 'site 1')) AND is_active")
def _(t):
    return reports.site_search(t.site, search="Site 1", is_active=True).select("site_id", "name")


VIEWS["finding_row"] = """
    SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey AS page_id, split_part('completed,failed,pending', ',', CAST(1 + l_suppkey % 3 AS INT)) AS status, split_part('high,medium,low', ',', CAST(1 + l_orderkey % 3 AS INT)) AS priority,
           CAST(l_linenumber AS INT) AS n, concat('payload ', l_suppkey) AS payload FROM {lineitem}"""


@query("flt09_recommendation_list", "SELECT finding_id, f.page_id, p.url, CAST(n AS INTEGER) AS finding_count FROM {finding_row} f JOIN {page} p ON p.page_id = f.page_id WHERE status = 'completed' AND priority = 'high'")
def _(t):
    findings = t.finding_row.withColumn("findings", F.array_repeat(F.lit("x"), F.col("n")))
    return reports.recommendation_list(findings, t.page, priority="HIGH").select("finding_id", "page_id", "url", "finding_count")


@query("flt10_compact_evidence", "SELECT doc_id, concat('source: ', source, '; text: ', text) AS line FROM documents")
def _(t):
    evidence = F.create_map(F.lit("source"), F.col("source"), F.lit("text"), F.col("text"))
    return t.documents.select("doc_id", reports.compact_evidence(evidence).alias("line"))


# ── summaries ────────────────────────────────────────────────────────────────
common(
    "rule_summary",
    f"""SELECT sid AS site_id, rule_id, CAST(sum(n) AS BIGINT) AS issue_count, CAST(sum(p) AS BIGINT) AS page_count, max(rk) AS rk FROM (
          SELECT sid, rule_id, title, severity, {RANK} AS rk, count(*) AS n, count(DISTINCT page_id) AS p FROM {{open_issue}} GROUP BY ALL) GROUP BY sid, rule_id""",
)
_SEV = "split_part('NONE,LOW,MEDIUM,HIGH,CRITICAL', ',', CAST(1 + rk AS INTEGER))"


@query("agg09_issue_summary", f"SELECT site_id, rule_id, issue_count, page_count, {_SEV} AS severity FROM {{rule_summary}}")
def _(t):
    return reports.issue_summary(opened(t)).select("site_id", "rule_id", "issue_count", "page_count", "severity")


@query("agg09_severity_summary", "SELECT sid AS site_id, severity, count(*) AS issue_count FROM {open_issue} GROUP BY ALL")
def _(t):
    return reports.severity_summary(opened(t))


@query("top10_top_rules", "SELECT site_id, rule_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rk DESC, page_count DESC, rule_id) AS rn FROM {rule_summary}) WHERE rn <= 10")
def _(t):
    return reports.top_rules(reports.issue_summary(opened(t))).select("site_id", "rule_id", "place")


_dist = lambda name, expr: f"SELECT site_id, '{name}' AS dimension, {expr} AS value, count(*) AS n FROM {{page}} WHERE is_active AND {expr} IS NOT NULL GROUP BY ALL"
_CLASS = "CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 300 AND 399 THEN '3xx' WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code >= 500 THEN '5xx' ELSE 'unreachable' END"


@query(
    "agg10_distributions",
    " UNION ALL ".join([_dist("seo_category", "seo_category"), _dist("priority_band", "priority_band"), _dist("ai_status", "ai_status"), _dist("status_class", _CLASS), "SELECT sid, 'issue_severity', severity, count(*) FROM {open_issue} GROUP BY ALL"]),
)
def _(t):
    return reports.distributions(t.page, opened(t))


VIEWS["connection"] = "SELECT n_nationkey + 1 AS site_id, CASE n_nationkey % 3 WHEN 0 THEN 'connected' WHEN 1 THEN 'error' ELSE 'not_connected' END AS ga4_status FROM {nation}"
VIEWS["run"] = "SELECT o_orderkey AS run_id, CAST(1 + o_custkey % 25 AS INT) AS site_id, split_part('queued,running,completed,failed', ',', CAST(1 + o_orderkey % 4 AS INT)) AS run_status FROM {orders}"
common(
    "portfolio",
    f"""SELECT s.site_id, s.name, coalesce(g.total_pages, 0) AS total_pages, g.average_seo_score, coalesce(g.p0, 0) AS p0_pages, coalesce(g.p1, 0) AS p1_pages, coalesce(g.p0, 0) + coalesce(g.p1, 0) AS high_priority_pages, coalesce(i.n, 0) AS total_issues, coalesce(i.c, 0) AS critical_issues,
          CASE WHEN a.users IS NULL AND c.ga4_status = 'connected' THEN 0 ELSE a.users END AS users, CASE WHEN a.users IS NULL AND c.ga4_status = 'connected' THEN 0 ELSE a.revenue END AS revenue, CASE WHEN a.users IS NULL AND c.ga4_status = 'connected' THEN 0 ELSE a.conversions END AS conversions,
          coalesce(k.clicks, 0) AS clicks, coalesce(k.impressions, 0) AS impressions, x.run_id AS active_run, c.ga4_status
        FROM {{site}} s LEFT JOIN (SELECT site_id, count(*) AS total_pages, {r('avg(seo_score)', 1)} AS average_seo_score, count(*) FILTER (WHERE priority_band = 'P0') AS p0, count(*) FILTER (WHERE priority_band = 'P1') AS p1 FROM {{page}} WHERE is_active GROUP BY 1) g USING (site_id)
        LEFT JOIN (SELECT sid AS site_id, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c FROM {{open_issue}} GROUP BY 1) i USING (site_id)
        LEFT JOIN (SELECT site_id, CAST(sum(users) AS BIGINT) AS users, sum(revenue) AS revenue, sum(conversions) AS conversions FROM {{ga4}} WHERE date >= DATE '{TODAY}' - 90 GROUP BY 1) a USING (site_id)
        LEFT JOIN (SELECT site_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM {{gsc}} WHERE date >= DATE '{TODAY}' - 90 GROUP BY 1) k USING (site_id)
        LEFT JOIN {{connection}} c USING (site_id) LEFT JOIN (SELECT site_id, max(run_id) AS run_id FROM {{run}} WHERE run_status IN ('queued', 'running') GROUP BY 1) x USING (site_id)""",
)


def portfolio(t):
    return reports.portfolio(t.site, t.page, opened(t), gsc(t), ga4(t), t.connection, t.run, since())


@query(
    "agg11_portfolio_overview",
    f"SELECT site_id, name, total_pages, average_seo_score, p0_pages, high_priority_pages, total_issues, critical_issues, users, {r('revenue', 2)} AS revenue, clicks, impressions, active_run, ga4_status FROM {{portfolio}}",
)
def _(t):
    out = portfolio(t).orderBy(*reports.portfolio_order())
    return out.select(
        "site_id", "name", "total_pages", "average_seo_score", "p0_pages", "high_priority_pages", "total_issues", "critical_issues", "users",
        rnd("revenue", 2).alias("revenue"), "clicks", "impressions", "active_run", "ga4_status",
    )


@query(
    "agg12_portfolio_totals",
    f"""SELECT count(*) AS websites, CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(sum(critical_issues) AS BIGINT) AS critical_issues, CAST(sum(high_priority_pages) AS BIGINT) AS high_priority_pages, CAST(sum(total_issues) AS BIGINT) AS total_issues, CAST(sum(clicks) AS BIGINT) AS clicks,
          CAST(sum(impressions) AS BIGINT) AS impressions, CAST(coalesce(sum(users), 0) AS BIGINT) AS users, {r('sum(conversions)', 2)} AS conversions, {r('sum(revenue)', 2)} AS revenue, {r('avg(average_seo_score)', 1)} AS average_seo_score FROM {{portfolio}}""",
)
def _(t):
    return reports.portfolio_totals(portfolio(t))


@query(
    "agg19_keyword_catalogue",
    """SELECT site_id, keyword, count(*) AS page_count, max(coalesce(keyword_opportunity_score, 0)) AS keyword_opportunity_score, arg_min(k.page_id, rk) AS best_page_id, arg_min(p.url, rk) AS best_page_url FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, keyword ORDER BY coalesce(keyword_opportunity_score, 0) DESC, page_id, row_id) AS rk FROM {keyword_row}) k JOIN (SELECT page_id, url FROM {page}) p ON p.page_id = k.page_id GROUP BY site_id, keyword""",
)
def _(t):
    out, _ = reports.keyword_catalogue(t.keyword_row, t.page)
    return out.select("site_id", "keyword", "page_count", "keyword_opportunity_score", F.col("best.page_id").alias("best_page_id"), F.col("best.url").alias("best_page_url"))


@query("win04_newest_finding", "SELECT page_id, finding_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY finding_id DESC, payload DESC) AS rn FROM {finding_row} WHERE status = 'completed') WHERE rn = 1")
def _(t):
    done = t.finding_row.filter("status = 'completed'").select("page_id", "finding_id", "payload")
    return reports.newest_rows(done, ["finding_id", "payload"])


# ── rollups and series ───────────────────────────────────────────────────────
DAY = "2001-07-10"
common(
    "site_rollup",
    f"""SELECT p.site_id, count(*) AS page_count, {r('avg(seo_score)', 1)} AS seo_score, {r('avg(priority_score)', 1)} AS priority_score, coalesce(max(i.n), 0) AS issue_count, coalesce(max(i.c), 0) AS critical_count, coalesce(max(s.clicks), 0) AS clicks, coalesce(max(s.impressions), 0) AS impressions,
          coalesce(max(a.users), 0) AS users, coalesce(max(a.sessions), 0) AS sessions, {r('coalesce(max(a.conversions), 0)', 2)} AS conversions, {r('coalesce(max(a.revenue), 0)', 2)} AS revenue
        FROM {{page}} p LEFT JOIN (SELECT sid, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c FROM {{open_issue}} GROUP BY 1) i ON i.sid = p.site_id
        LEFT JOIN (SELECT site_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM {{gsc}} WHERE date = DATE '{DAY}' GROUP BY 1) s ON s.site_id = p.site_id
        LEFT JOIN (SELECT site_id, CAST(sum(users) AS BIGINT) AS users, CAST(sum(sessions) AS BIGINT) AS sessions, sum(conversions) AS conversions, sum(revenue) AS revenue FROM {{ga4}} WHERE date = DATE '{DAY}' GROUP BY 1) a ON a.site_id = p.site_id WHERE p.is_active GROUP BY p.site_id""",
)


@query("agg06_site_rollup", "SELECT * FROM {site_rollup}")
def _(t):
    out = rollup.site_rollup(t.page, opened(t), gsc(t), ga4(t), day=DAY).drop("page_id", "date", "scope")
    return out.withColumns({c: rnd(c, 2) for c in ("conversions", "revenue")})


@query("agg07_page_rollup", f"SELECT site_id, page_id, DATE '{DAY}' AS date, priority_score, CASE WHEN highest_severity = 'CRITICAL' THEN 1 ELSE 0 END AS critical_count FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority_score DESC, page_id) AS rn FROM {{page}} WHERE is_active AND priority_score IS NOT NULL) WHERE rn <= 30")
def _(t):
    # The default keeps 500 pages per site; the smaller figure makes the cut visible at this scale.
    return rollup.page_rollup(t.page, day=DAY, k=30).select("site_id", "page_id", "date", "priority_score", "critical_count")


VIEWS["history"] = "SELECT l_partkey AS page_id, CAST(1 + l_partkey % 25 AS INT) AS site_id, CAST(l_shipdate AS DATE) AS date, MAX(CAST(l_quantity AS DOUBLE)) AS seo_score, MAX(CAST(l_suppkey AS DOUBLE)) AS priority_score, MAX(l_linenumber) AS issue_count FROM {lineitem} GROUP BY 1, 2, 3"


def series_sql(key: str) -> str:
    return f"""SELECT {key}, date, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(users) AS BIGINT) AS users, {r('sum(revenue)', 2)} AS revenue, max(seo_score) AS seo_score, CAST(coalesce(max(issue_count), 0) AS BIGINT) AS issue_count FROM (
        SELECT {key}, date, clicks, impressions, 0 AS users, 0 AS revenue, NULL AS seo_score, NULL AS issue_count FROM {{gsc}} UNION ALL SELECT {key}, date, 0, 0, users, revenue, NULL, NULL FROM {{ga4}} UNION ALL SELECT {key}, date, 0, 0, 0, 0, seo_score, issue_count FROM {{history}}) WHERE date >= DATE '2001-05-03' GROUP BY ALL"""


def _series(t, key):
    out = rollup.daily_series(key, gsc(t), ga4(t), t.history, since="2001-05-03")
    return out.select(key, "date", "clicks", "impressions", "users", "revenue", "seo_score", "issue_count")


@query("jn07_page_series", series_sql("page_id"))
def _(t):
    return _series(t, "page_id")


@query("jn07_site_series", series_sql("site_id"))
def _(t):
    return _series(t, "site_id")


# ── matrix and roadmap ───────────────────────────────────────────────────────
_LEVEL = "CASE priority_level WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END"
common(
    "best_score",
    f"""SELECT page_id, max(search_impact_score) AS best_search, max(user_activity_score) AS best_activity, max(business_impact_score) AS best_business, concat('P', min({_LEVEL})) AS level, arg_min(recommendation_type, rk) AS top_type, arg_min(reason, rk) AS top_reason FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overall_priority DESC, score_id, recommendation_type DESC) AS rk FROM {{stored_score}}) GROUP BY page_id""",
)
_overall = "0.25 * coalesce(best_search, 0) + 0.20 * coalesce(best_activity, 0) + 0.20 * coalesce(best_business, 0) + 0.20 * tech + 0.15 * coalesce(kw, 0)"
common(
    "matrix",
    f"""SELECT site_id, page_id, url, coalesce(best_search, 0) AS seo_opportunity, coalesce(best_activity, 0) AS user_activity_opportunity, coalesce(best_business, 0) AS business_value, tech AS technical_severity, {r('coalesce(kw, 0)', 1)} AS keyword_opportunity, {r(_overall, 1)} AS overall_priority,
          coalesce(level, CASE WHEN {_overall} >= 70 THEN 'P0' WHEN {_overall} >= 50 THEN 'P1' WHEN {_overall} >= 30 THEN 'P2' ELSE 'P3' END) AS priority_level, top_type AS top_recommendation, top_reason AS top_recommendation_reason FROM (
        SELECT p.*, b.* EXCLUDE (page_id), f.keyword_opportunity_score AS kw, CAST(CASE highest_severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 40 WHEN 'LOW' THEN 15 ELSE 0 END AS DOUBLE) AS tech
        FROM {{page}} p LEFT JOIN {{best_score}} b ON b.page_id = p.page_id LEFT JOIN {{profile}} f ON f.page_id = p.page_id WHERE p.is_active)""",
)
MATRIX = "site_id, page_id, seo_opportunity, user_activity_opportunity, business_value, technical_severity, keyword_opportunity, overall_priority, priority_level, top_recommendation"


def matrix(t):
    return rm.priority_matrix(t.page, t.stored_score, profiles(t))


@query("agg22_best_recommendation", "SELECT page_id, best_search, best_activity, best_business, level, top_type FROM {best_score}")
def _(t):
    return rm.best_recommendations(t.stored_score).select("page_id", "best_search", "best_activity", "best_business", "level", "top_type")


@query("pipe09_priority_matrix", f"SELECT {MATRIX} FROM {{matrix}}")
def _(t):
    return matrix(t).select(*MATRIX.split(", "))


_band = lambda c: f"CASE WHEN {r(f'avg({c})', 6)} >= 65 THEN 'HIGH' WHEN {r(f'avg({c})', 6)} >= 35 THEN 'MEDIUM' ELSE 'LOW' END"
common(
    "overview",
    f"""SELECT site_id, {r('avg(overall_priority)', 1)} AS overall_seo_opportunity, {_band('seo_opportunity')} AS organic_growth_opportunity, {_band('user_activity_opportunity')} AS user_activity_opportunity, count(*) FILTER (WHERE priority_level = 'P0') AS p0_pages,
          count(*) FILTER (WHERE priority_level = 'P3') AS p3_pages FROM {{matrix}} GROUP BY site_id""",
)


@query("agg23_site_opportunity", "SELECT * FROM {overview}")
def _(t):
    return rm.site_overview(matrix(t)).drop("p1_pages", "p2_pages")


common(
    "week",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, week ORDER BY priority_level, overall_priority DESC, item_id, recommendation_type) AS position FROM (
         SELECT site_id, page_id, score_id AS item_id, recommendation_type, priority_level, overall_priority, 'recommendation' AS source, CASE WHEN priority_level IN ('P0', 'P1') THEN 1 WHEN priority_level = 'P2' THEN 2 ELSE 3 END AS week FROM {stored_score} WHERE status IN ('detected', 'approved')
         UNION ALL SELECT site_id, page_id, page_id, 'technical_issue', priority_level, overall_priority, 'matrix', CASE WHEN priority_level IN ('P0', 'P1') THEN 1 WHEN priority_level = 'P2' THEN 2 ELSE 3 END FROM {matrix}
           WHERE top_recommendation IS NOT NULL AND site_id NOT IN (SELECT site_id FROM {stored_score} WHERE status IN ('detected', 'approved')))) WHERE position <= week * 10""",
)


@query("top09_roadmap_weeks", "SELECT site_id, week, position, item_id, page_id, priority_level, overall_priority, source FROM {week}")
def _(t):
    return rm.roadmap_weeks(t.stored_score, t.page, cut(matrix(t))).select("site_id", "week", "position", "item_id", "page_id", "priority_level", "overall_priority", "source")


@query(
    "pipe10_roadmap",
    """SELECT o.site_id, o.overall_seo_opportunity, o.organic_growth_opportunity, c.p0 AS critical_issue_count, c.p3 AS low_impact_count, w.items AS items FROM {overview} o
       LEFT JOIN (SELECT site_id, count(*) FILTER (WHERE priority_level = 'P0') AS p0, count(*) FILTER (WHERE priority_level = 'P3') AS p3 FROM {stored_score} WHERE status IN ('detected', 'approved') GROUP BY 1) c ON c.site_id = o.site_id
       LEFT JOIN (SELECT site_id, count(*) AS items FROM {week} GROUP BY 1) w ON w.site_id = o.site_id""",
)
def _(t):
    out = rm.roadmap(t.stored_score, t.page, cut(matrix(t)), generated_on=TODAY)
    size = F.when(F.col("weeks").isNotNull(), F.size("weeks").cast("long"))
    return out.select("site_id", "overall_seo_opportunity", "organic_growth_opportunity", "critical_issue_count", "low_impact_count", size.alias("items"))


# ── search results ───────────────────────────────────────────────────────────
VIEWS.update(
    {
        "serp_payload": """
            SELECT o_orderkey AS search_id, concat('kw ', o_custkey) AS keyword, concat('{"organic_results":[{"position":1,"link":"https://a.test/', o_orderkey, '","title":"t"},{"link":"', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'https://b.test/' END,
                   '","title":"u"},{"link":"https://c.test/x","snippet":"s"}],"related_questions":[{"question":"what ', o_custkey, '"},{"snippet":"none"}],"related_searches":[{"query":"more ', o_custkey, '"},{"query":""}]}') AS payload FROM {orders}""",
        "serp_result": """
            SELECT concat('kw ', l_orderkey % 3000) AS keyword, concat('https://c', l_suppkey, '.test/', l_partkey) AS url, CASE WHEN l_returnflag = 'A' THEN 'blocked' ELSE 'ok' END AS fetch_status, CAST(l_quantity * 40 AS INT) AS word_count, CAST(l_linenumber AS INT) AS h2_count,
                   concat(CASE WHEN l_suppkey % 2 = 0 THEN 'What ' ELSE 'what ' END, split_part('fits,costs,breaks,lasts', ',', CAST(1 + l_partkey % 4 AS INT))) AS heading, CASE WHEN l_partkey % 7 = 0 THEN 'h4' ELSE 'h2' END AS level FROM {lineitem}""",
    }
)


@query(
    "src10_organic_results",
    """SELECT o_orderkey AS search_id, p AS position, url FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [1, 2] ELSE [1, 2, 3] END) AS p, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [concat('https://a.test/', o_orderkey), 'https://c.test/x'] ELSE [concat('https://a.test/', o_orderkey), 'https://b.test/', 'https://c.test/x'] END) AS url FROM orders)""",
)
def _(t):
    return serp.organic_results(t.serp_payload).select("search_id", "position", "url")


@query("src10_questions_and_related", "SELECT o_orderkey AS search_id, concat('what ', o_custkey) AS text FROM orders UNION ALL SELECT o_orderkey, concat('more ', o_custkey) FROM orders")
def _(t):
    asked = serp.questions(t.serp_payload).select("search_id", F.col("question").alias("text"))
    return asked.unionByName(serp.related_searches(t.serp_payload).select("search_id", F.col("query").alias("text")))


@query(
    "agg18_competitor_gap",
    f"""SELECT o.keyword, s.median_word_count, s.avg_h2_count, m.topics FROM (SELECT DISTINCT keyword FROM {{serp_result}}) o
        LEFT JOIN (SELECT keyword, max(CASE WHEN rn = n // 2 + 1 THEN word_count END) AS median_word_count, {r('avg(h2_count)', 1)} AS avg_h2_count FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY word_count, url) AS rn, count(*) OVER (PARTITION BY keyword) AS n FROM {{serp_result}} WHERE fetch_status = 'ok') GROUP BY keyword) s ON s.keyword = o.keyword
        LEFT JOIN (SELECT keyword, string_agg(topic, '|' ORDER BY c DESC, topic) AS topics FROM (SELECT keyword, lower(heading) AS topic, count(DISTINCT url) AS c FROM {{serp_result}} WHERE fetch_status = 'ok' AND level = 'h2' AND lower(heading) <> 'what lasts' GROUP BY 1, 2 HAVING count(DISTINCT url) >= 2) GROUP BY keyword) m ON m.keyword = o.keyword""",
)
def _(t):
    own = t.serp_result.select("keyword").distinct().withColumns({"h1": F.lit(" What lasts"), "word_count": F.lit(500)})
    headings = t.serp_result.select("keyword", "url", "level", F.col("heading").alias("text"))
    out = serp.competitor_gap(t.serp_result, headings, own)
    topics = F.lower(F.array_join("missing_subtopics", "|"))
    return out.select("keyword", "median_word_count", "avg_h2_count", topics.alias("topics"))


# ── dossiers, action plans, exports ──────────────────────────────────────────
VIEWS["priority_row"] = "SELECT l_orderkey * 10 + l_linenumber AS priority_id, l_partkey AS page_id, CAST(l_quantity AS DOUBLE) AS score, split_part('P0,P1,P2,P3', ',', CAST(1 + l_suppkey % 4 AS INT)) AS band FROM {lineitem}"


@query(
    "pipe14_page_dossier",
    """SELECT p.page_id, coalesce(i.n, 0) AS open_rules, m.impressions, m.users, s.score, f.finding_id FROM {page} p LEFT JOIN (SELECT page_id, count(DISTINCT rule_id) AS n FROM {issue} WHERE NOT is_resolved GROUP BY 1) i ON i.page_id = p.page_id
       LEFT JOIN {page_metric} m ON m.page_id = p.page_id LEFT JOIN (SELECT page_id, max_by(score, priority_id * 100 + score) AS score FROM {priority_row} GROUP BY 1) s ON s.page_id = p.page_id LEFT JOIN (SELECT page_id, max(finding_id) AS finding_id FROM {finding_row} GROUP BY 1) f ON f.page_id = p.page_id""",
)
def _(t):
    audits = t.issue.select("page_id", "audit_id", F.col("title").alias("checks"))
    metrics = page_metrics(t).select("page_id", "impressions", "users")
    out = reports.page_dossier(t.page, t.issue, audits, metrics, t.priority_row, t.finding_row)
    rules = F.when(F.col("issues").isNull(), F.lit(0)).otherwise(F.size("issues"))
    return out.select("page_id", rules.cast("long").alias("open_rules"), "impressions", "users", "score", "finding_id")


VIEWS["competitor_row"] = "SELECT o_orderkey AS analysis_id, o_custkey AS page_id, concat('kw ', o_orderkey) AS keyword, CAST(o_orderkey % 900 AS INT) AS median_word_count FROM {orders}"


@query(
    "pipe13_url_action_plan",
    """SELECT p.page_id, m.impressions, f.detected_intent, coalesce(f.intent_mismatch, FALSE) AS intent_mismatch, c.keyword, c.analysis_id IS NOT NULL AS competitors_available, coalesce(s.n, 0) AS actions, s.first_action FROM {page} p LEFT JOIN {page_metric} m ON m.page_id = p.page_id LEFT JOIN {profile} f ON f.page_id = p.page_id
       LEFT JOIN (SELECT page_id, max(analysis_id) AS analysis_id, max_by(keyword, analysis_id) AS keyword FROM {competitor_row} GROUP BY 1) c ON c.page_id = p.page_id LEFT JOIN (SELECT page_id, count(*) AS n, arg_min(recommendation_type, rk) AS first_action FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overall_priority DESC, score_id, recommendation_type) AS rk FROM {stored_score}) GROUP BY 1) s ON s.page_id = p.page_id""",
)
def _(t):
    out = reports.action_plan(t.page, page_metrics(t).drop("site_id"), profiles(t), t.stored_score, t.competitor_row)
    return out.select(
        "page_id", "impressions", "detected_intent", "intent_mismatch", "keyword", "competitors_available", F.col("action_count").alias("actions"), F.col("first_action.recommendation_type").alias("first_action"),
    )


@query(
    "pipe13_action_rows",
    "SELECT page_id, score_id, recommendation_type, status, row_number() OVER (PARTITION BY page_id ORDER BY overall_priority DESC, score_id, recommendation_type) AS action_rank FROM {stored_score}",
)
def _(t):
    return reports.action_rows(t.stored_score).select("page_id", "score_id", "recommendation_type", "status", "action_rank")


def written(t, tables, fmt="parquet"):
    """Through a written export and back."""
    folder = f"{checkpoint_dir(t.spark)}/export-{uuid.uuid4().hex}"
    return exports.read_tables(t.spark, folder, exports.write_tables(tables, folder, fmt=fmt))


_line = lambda *xs: "concat_ws('|', " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '-')" for x in xs) + ")"


@query(
    "snk07_audit_report",
    f"""SELECT 'page_overview' AS table_name, p.page_id AS id, {_line('p.site_id', 'p.url', 'p.seo_category', 'm.impressions', 'm.users')} AS line FROM {{page}} p LEFT JOIN {{page_metric}} m ON m.page_id = p.page_id WHERE p.is_active
       UNION ALL SELECT 'issues', issue_id, {_line('page_id', 'rule_id', 'severity', 'title', 'description')} FROM {{open_issue}}
       UNION ALL SELECT 'findings', finding_id, {_line('page_id', 'payload', 'status')} FROM (SELECT f.*, row_number() OVER (PARTITION BY f.page_id ORDER BY finding_id DESC) AS rn FROM {{finding_row}} f JOIN {{page}} p ON p.page_id = f.page_id WHERE p.is_active AND status = 'completed') WHERE rn = 1
       UNION ALL SELECT 'keywords', row_id, {_line('k.site_id', 'k.page_id', 'keyword', 'keyword_tier', 'source', 'p.url')} FROM {{keyword_row}} k JOIN {{page}} p ON p.page_id = k.page_id WHERE p.is_active
       UNION ALL SELECT 'summary', site_id, {_line('count(*)', 'sum(issue_count)')} FROM {{page}} WHERE is_active GROUP BY site_id""",
)
def _(t):
    tables = reports.audit_report(t.page, opened(t), t.finding_row, t.keyword_row.drop("url"), page_metrics(t).select("page_id", "impressions", "users"))
    back = written(t, tables)
    line = lambda name, key, *columns: back[name].select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("id"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("line"))
    return (
        line("page_overview", "page_id", "site_id", "url", "seo_category", "impressions", "users")
        .unionByName(line("issues", "issue_id", "page_id", "rule_id", "severity", "title", "description"))
        .unionByName(line("findings", "finding_id", "page_id", "payload", "status"))
        .unionByName(line("keywords", "row_id", "site_id", "page_id", "keyword", "keyword_tier", "source", "url"))
        .unionByName(line("summary", "site_id", "pages", "issues"))
    )


@query(
    "snk08_issue_export",
    f"""SELECT p.site_id, p.page_id, p.url, p.title, p.seo_score, p.priority_score, p.priority_band, p.highest_severity, p.issue_count, m.users, m.sessions, m.clicks, m.impressions, f.detected_intent, t.s AS top_issues FROM {{page}} p JOIN {{page_metric}} m ON m.page_id = p.page_id LEFT JOIN {{profile}} f ON f.page_id = p.page_id
        LEFT JOIN (SELECT page_id, string_agg(title, '; ' ORDER BY rn) AS s FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {RANK} DESC, issue_id) AS rn FROM {{issue}} WHERE NOT is_resolved) WHERE rn <= 3 GROUP BY page_id) t ON t.page_id = p.page_id
        WHERE p.is_active AND p.issue_count > 0 AND p.page_id IN (SELECT page_id FROM {{issue}} WHERE rule_id = 'title' AND NOT is_resolved)""",
)
def _(t):
    pages = reports.issue_export(t.page, t.issue, "title", page_metrics(t), profiles(t), has_issues=True)
    return written(t, {"pages": pages}, "csv")["pages"]
