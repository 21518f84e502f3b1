"""Domain frames derived from the supplied tables.

The same SELECT text feeds Spark and the SQL check, so both sides start from identical inputs; the
operators under test are written separately in each. Names in braces are tables or other views.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

TODAY = "2001-08-01"

SITE_OF_PART = "CAST(substr(p_brand, 7) AS INT)"


def gone(page: str, every: int) -> str:
    """Page ids, those of every so-maniest site beyond the ids of the page table: rows of pages that are gone, so their sites have none."""
    return f"({page}) + CASE WHEN {SITE_OF_PART} % {every} = 0 THEN 1000000000 ELSE 0 END"



VIEWS: dict[str, str] = {
    # Website and page snapshot from part.
    "site": f"""
        SELECT DISTINCT {SITE_OF_PART} AS site_id, concat('Site ', {SITE_OF_PART}) AS name,
               concat('www.site', {SITE_OF_PART}, '.test') AS domain,
               {SITE_OF_PART} % 6 <> 0 AS is_active
        FROM {{part}}""",
    "page": f"""
        SELECT p_partkey AS page_id, {SITE_OF_PART} AS site_id,
               concat('https://www.site', {SITE_OF_PART}, '.test/', lower(p_type), '/', replace(p_name, ' ', '-'), '-', p_partkey) AS url,
               concat('/', lower(p_type), '/', replace(p_name, ' ', '-'), '-', p_partkey) AS path,
               p_partkey % 23 <> 0 AS is_active,
               CASE p_partkey % 17 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 200 END AS status_code,
               concat(p_name, ' ', p_type) AS title, p_name AS h1,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(200 - p_size * 3 AS DOUBLE) / 2 END AS seo_score,
               CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_size < 7 THEN 'LOW ISSUES' WHEN p_size < 17 THEN 'MEDIUM ISSUES' ELSE 'HIGH ISSUES' END AS seo_category,
               CASE WHEN p_size >= 46 THEN 'CRITICAL' WHEN p_size >= 31 THEN 'HIGH' WHEN p_size >= 16 THEN 'MEDIUM' WHEN p_size >= 6 THEN 'LOW' ELSE 'NONE' END AS highest_severity,
               p_size % 13 AS issue_count,
               CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 1000 AS DOUBLE) / 10 END AS priority_score,
               CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN (p_partkey * 37) % 1000 >= 950 THEN 'P0' WHEN (p_partkey * 37) % 1000 >= 800 THEN 'P1' WHEN (p_partkey * 37) % 1000 >= 500 THEN 'P2' ELSE 'P3' END AS priority_band,
               CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'queued' END AS ai_status,
               p_size * 25 AS word_count, concat(p_name, '|', p_size) AS content_key
        FROM {{part}}""",
    # Search rows from lineitem: several rows per page and day stand for URL variants.
    "gsc_raw": f"""
        SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey AS page_id, {SITE_OF_PART} AS site_id,
               CAST(l_shipdate AS DATE) AS date, CAST(l_quantity * 10 AS BIGINT) AS impressions,
               CAST(floor(l_quantity * round(l_discount * 100) / 10) AS BIGINT) AS clicks,
               CAST(10 + l_orderkey % 300 AS DOUBLE) / 10 AS position
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    # Analytics rows from events, shifted to end just before TODAY; those of every fifth site are of a site and pages that are gone.
    "ga4_raw": f"""
        SELECT event_id AS row_id, {gone('user_id * 13', 5)} AS page_id, {SITE_OF_PART} + CASE WHEN {SITE_OF_PART} % 5 = 0 THEN 1000 ELSE 0 END AS site_id,
               CAST(ts AS DATE) - 8225 AS date,
               CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS users,
               CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS BIGINT) AS new_users,
               CAST(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS BIGINT) AS sessions,
               CAST(CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END AS BIGINT) AS screen_page_views,
               CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS engaged_sessions,
               CAST(event_id % 100 AS DOUBLE) / 100 AS engagement_rate,
               CAST(event_id % 50 AS DOUBLE) / 50 AS bounce_rate,
               CAST(event_id % 240 AS DOUBLE) AS duration,
               CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS DOUBLE) AS conversions,
               CASE WHEN event_type = 'purchase' THEN value ELSE CAST(0 AS DOUBLE) END AS purchase_revenue,
               CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE CAST(0 AS DOUBLE) END AS total_revenue
        FROM {{events}} JOIN {{part}} ON user_id * 13 = p_partkey""",
    # Keyword-tool snapshots from orders; those of every seventh site are of a site and pages that are gone.
    "semrush": f"""
        SELECT o_orderkey AS snapshot_id, {gone('o_custkey', 7)} AS page_id, {SITE_OF_PART} + CASE WHEN {SITE_OF_PART} % 7 = 0 THEN 1000 ELSE 0 END AS site_id,
               CAST(o_orderdate AS DATE) AS date, o_orderkey % 200 AS organic_keywords,
               CAST(floor(o_totalprice / 100) AS BIGINT) AS organic_traffic,
               o_orderkey % 40 AS striking_distance_keywords, (o_orderkey * 7) % 5000 AS opportunity_volume,
               o_orderkey % 300 AS backlinks
        FROM {{orders}} JOIN {{part}} ON o_custkey = p_partkey""",
    # Settings rows: one global row from region, site rows from nation.
    "setting_flat": """
        SELECT CAST(NULL AS INT) AS site_id, '0.5' AS seo_severity, '0.2' AS ga4_activity, '0.2' AS gsc_search, 'n/a' AS semrush_opportunity
        FROM {region} WHERE r_regionkey = 0
        UNION ALL
        SELECT n_nationkey + 1 AS site_id, CASE n_nationkey % 4 WHEN 0 THEN '0.3' WHEN 1 THEN '-1' WHEN 2 THEN 'high' ELSE '0' END,
               CASE n_nationkey % 3 WHEN 0 THEN '0.4' WHEN 1 THEN NULL ELSE '0' END,
               CASE n_nationkey % 5 WHEN 0 THEN '0.1' ELSE NULL END,
               CASE n_nationkey % 2 WHEN 0 THEN '0.25' ELSE NULL END
        FROM {nation} WHERE n_nationkey % 3 <> 1""",
}

_REF = re.compile(r"\{(\w+)\}")


def references(text: str) -> set[str]:
    return set(_REF.findall(text))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or a derived view as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for ref in references(text):
        view = f"{ref}_{zlib.crc32(sf_dir.encode()):x}"
        frame(spark, sf_dir, ref).createOrReplaceTempView(view)
        text = text.replace("{" + ref + "}", view)
    return spark.sql(text)


def sql_prelude(body: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding every view the SQL text refers to (as {name}), then the text itself."""
    views = {**VIEWS, **(extra or {})}
    ordered: dict[str, str] = {}

    def visit(text: str) -> None:
        for ref in sorted(references(text)):
            if ref in views and ref not in ordered:
                visit(views[ref])
                ordered[ref] = views[ref]

    visit(body)
    sub = lambda text: _REF.sub(lambda m: m.group(1) if m.group(1) not in views else f"v_{m.group(1)}", text)
    ctes = ",\n".join(f"v_{name} AS ({sub(text)})" for name, text in ordered.items())
    return (f"WITH {ctes}\n" if ctes else "") + sub(body)
