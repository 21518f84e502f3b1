"""Provider rows, daily facts, snapshots, upserts and page resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.operators import facts, metrics, resolve
from siteledger.sources import providers

from .registry import common, query, r
from .views import TODAY, VIEWS

SINCE = f"(DATE '{TODAY}' - 90)"

VIEWS.update(
    {
        # Search payloads: one JSON row per line item; some rows have one key or a broken date.
        "gsc_payload": """
            SELECT l_orderkey * 10 + l_linenumber AS row_id,
                   concat('{"keys":[', CASE WHEN l_linenumber = 7 THEN '' ELSE concat('"', CASE WHEN l_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) END, '",') END,
                          '"https://www.site.test/', l_partkey, '"],"clicks":', CAST(l_quantity AS BIGINT), ',"impressions":', CAST(l_quantity AS BIGINT) * 10,
                          ',"ctr":', l_discount, ',"position":', l_orderkey % 300, '.125}') AS payload
            FROM {lineitem}""",
        "ga4_payload": """
            SELECT user_id, concat('{"dimensionHeaders":[{"name":"date"},{"name":"pagePath"}],"metricHeaders":[{"name":"sessions"},{"name":"purchaseRevenue"}],"rows":[{"dimensionValues":[{"value":"202401',
                   CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, event_id % 28 + 1, '"},{"value":"/p/', user_id, '"}],"metricValues":[{"value":"', event_id % 7, '"},{"value":"',
                   CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(event_id % 1000 AS VARCHAR(10)) END, '"}]}]}') AS payload, event_id
            FROM {events}""",
        "semrush_body": """
            SELECT s_suppkey AS report_id,
                   CASE WHEN s_suppkey % 10 = 0 THEN 'ERROR 50 :: NOTHING FOUND' WHEN s_suppkey % 10 = 1 THEN 'ERROR 120 :: WRONG KEY'
                        WHEN s_suppkey % 2 = 0 THEN concat('Keyword;Position;Search Volume;CPC;Keyword Difficulty Index', chr(10), s_name, ';', s_suppkey % 30, ';', s_suppkey * 11, ';0.5;n/a', chr(10), 'second ', s_nationkey, ';4;;1.25;33')
                        ELSE concat('Ph;Po;Nq;Cp', chr(10), s_name, ';x;', s_suppkey * 3, ';0.75', chr(10), ';7;1;1') END AS body
            FROM {supplier}""",
        # Keyword rows of a snapshot: every line of an order is one keyword.
        "snapshot_keyword": """
            SELECT o_orderkey AS snapshot_id, o_custkey AS page_id, CAST(o_orderdate AS DATE) AS date,
                   concat(p_name, ' ', l_linenumber, ' ', l_suppkey) AS keyword, CAST(l_quantity AS INT) AS position,
                   CAST(floor(l_extendedprice / 100) AS INT) AS volume, l_tax AS cpc, CAST(l_suppkey % 100 AS DOUBLE) AS difficulty
            FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey""",
        "search_query": """
            SELECT l_partkey AS page_id, concat(p_name, ' ', lower(p_type), ' ', l_suppkey % 10) AS query,
                   SUM(CAST(floor(l_quantity * round(l_discount * 100) / 10) AS BIGINT)) AS clicks,
                   SUM(CAST(l_quantity * 10 AS BIGINT)) AS impressions, MIN(CAST(10 + l_orderkey % 300 AS DOUBLE) / 10) AS position
            FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    }
)

common(
    "gsc",
    f"""SELECT site_id, page_id, date, CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions,
          CASE WHEN impressions <> 0 THEN {r('clicks / impressions', 6)} ELSE 0 END AS ctr,
          CASE WHEN impressions <> 0 THEN {r('w / impressions', 2)} END AS position
        FROM (SELECT site_id, page_id, date, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) AS w
              FROM {{gsc_raw}} GROUP BY site_id, page_id, date)""",
)
common(
    "ga4",
    f"""SELECT site_id, page_id, date, CAST(sum(users) AS BIGINT) AS users, CAST(sum(new_users) AS BIGINT) AS new_users,
          CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(screen_page_views) AS BIGINT) AS screen_page_views,
          CAST(sum(engaged_sessions) AS BIGINT) AS engaged_sessions,
          CASE WHEN sum(sessions) <> 0 THEN {r('sum(engagement_rate * sessions) / sum(sessions)', 4)} ELSE 0 END AS engagement_rate,
          CASE WHEN sum(sessions) <> 0 THEN {r('sum(bounce_rate * sessions) / sum(sessions)', 4)} ELSE 0 END AS bounce_rate,
          CASE WHEN sum(sessions) <> 0 THEN {r('sum(duration) / sum(sessions)', 2)} ELSE 0 END AS average_engagement_time,
          {r('sum(conversions)', 2)} AS conversions,
          {r('sum(CASE WHEN purchase_revenue <> 0 THEN purchase_revenue ELSE total_revenue END)', 2)} AS revenue
        FROM {{ga4_raw}} GROUP BY site_id, page_id, date""",
)
common(
    "snapshot_newest",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY date DESC, snapshot_id DESC) AS rn
          FROM {{semrush}} WHERE date >= {SINCE}) WHERE rn = 1""",
)


def metrics_sql(pages: str, since: str = SINCE, until: str | None = None) -> str:
    upper = f" AND date < {until}" if until else ""
    return f"""SELECT p.*, coalesce(a.users, 0) AS users, coalesce(a.sessions, 0) AS sessions, a.engagement_rate, a.average_engagement_time,
          coalesce(a.conversions, 0) AS conversions, coalesce(a.revenue, 0) AS revenue,
          coalesce(s.clicks, 0) AS clicks, coalesce(s.impressions, 0) AS impressions, s.ctr, s.position,
          coalesce(k.organic_keywords, 0) AS organic_keywords, coalesce(k.organic_traffic, 0) AS organic_traffic,
          coalesce(k.striking_distance_keywords, 0) AS striking_distance_keywords, coalesce(k.opportunity_volume, 0) AS opportunity_volume,
          coalesce(k.backlinks, 0) AS backlinks
        FROM {pages} p
        LEFT JOIN (SELECT page_id, CAST(sum(users) AS BIGINT) AS users, CAST(sum(sessions) AS BIGINT) AS sessions, avg(engagement_rate) AS engagement_rate,
                          avg(average_engagement_time) AS average_engagement_time, sum(conversions) AS conversions, sum(revenue) AS revenue
                   FROM {{ga4}} WHERE date >= {since}{upper} GROUP BY page_id) a ON a.page_id = p.page_id
        LEFT JOIN (SELECT page_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
                          {r('avg(position)', 1)} AS position, CASE WHEN sum(impressions) > 0 THEN {r('sum(clicks) / sum(impressions)', 4)} END AS ctr
                   FROM {{gsc}} WHERE date >= {since}{upper} GROUP BY page_id) s ON s.page_id = p.page_id
        LEFT JOIN {{snapshot_newest}} k ON k.page_id = p.page_id"""


common("page_metric", metrics_sql("{page}"))

METRIC_OUT = """page_id, users, sessions, {eng} AS engagement_rate, {time} AS average_engagement_time, {conv} AS conversions, {rev} AS revenue,
  clicks, impressions, ctr, position, organic_keywords, organic_traffic, striking_distance_keywords, opportunity_volume, backlinks""".format(
    eng=r("engagement_rate", 6), time=r("average_engagement_time", 4), conv=r("conversions", 2), rev=r("revenue", 2)
)


def gsc(t):
    return facts.merge_search_days(t.gsc_raw)


def ga4(t):
    return facts.merge_activity_days(t.ga4_raw)


def page_metrics(t, pages=None, **kw):
    return metrics.page_metrics(t.page if pages is None else pages, gsc(t), ga4(t), t.semrush, **{"today": TODAY, **kw})


def metric_columns(df):
    rounded = {"engagement_rate": 6, "average_engagement_time": 4, "conversions": 2, "revenue": 2}
    return df.select(
        "page_id", *[metrics.rnd(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in metrics.METRIC_COLUMNS]
    )


# ── provider payloads ────────────────────────────────────────────────────────
@query(
    "src02_search_day_rows",
    """SELECT row_id, CAST(d AS DATE) AS date, raw_url, clicks, impressions, position FROM (
         SELECT row_id, try_cast(json_extract_string(payload, '$.keys[0]') AS DATE) AS d, json_extract_string(payload, '$.keys[1]') AS raw_url,
                CAST(json_extract(payload, '$.clicks') AS BIGINT) AS clicks, CAST(json_extract(payload, '$.impressions') AS BIGINT) AS impressions,
                CAST(json_extract(payload, '$.position') AS DOUBLE) AS position
         FROM {gsc_payload} WHERE json_array_length(payload, '$.keys') >= 2) WHERE d IS NOT NULL""",
)
def _(t):
    return providers.gsc_daily(t.gsc_payload)


@query(
    "src03_search_query_rows",
    f"""SELECT row_id, json_extract_string(payload, '$.keys[0]') AS raw_url, json_extract_string(payload, '$.keys[1]') AS query,
               CAST(json_extract(payload, '$.clicks') AS BIGINT) AS clicks, CAST(json_extract(payload, '$.impressions') AS BIGINT) AS impressions,
               {r("CAST(json_extract(payload, '$.ctr') AS DOUBLE)", 6)} AS ctr, {r("CAST(json_extract(payload, '$.position') AS DOUBLE)", 2)} AS position
        FROM {{gsc_payload}} WHERE json_array_length(payload, '$.keys') >= 2""",
)
def _(t):
    return providers.gsc_queries(t.gsc_payload)


@query(
    "src04_analytics_report_rows",
    """SELECT event_id, user_id, CAST(try_strptime(json_extract_string(payload, '$.rows[0].dimensionValues[0].value'), '%Y%m%d') AS DATE) AS date,
              json_extract_string(payload, '$.rows[0].dimensionValues[1].value') AS "pagePath",
              coalesce(try_cast(json_extract_string(payload, '$.rows[0].metricValues[0].value') AS DOUBLE), 0) AS sessions,
              coalesce(try_cast(json_extract_string(payload, '$.rows[0].metricValues[1].value') AS DOUBLE), 0) AS "purchaseRevenue"
       FROM {ga4_payload}""",
)
def _(t):
    rows = providers.ga4_rows(t.ga4_payload, ["date", "pagePath"], ["sessions", "purchaseRevenue"])
    return rows.withColumn("date", providers.ga4_date("date"))


@query(
    "src05_keyword_report_rows",
    """SELECT report_id, string_split(line, ';')[1] AS keyword,
              coalesce(CAST(try_cast(string_split(line, ';')[2] AS DOUBLE) AS INTEGER), 0) AS position,
              coalesce(CAST(try_cast(string_split(line, ';')[3] AS DOUBLE) AS INTEGER), 0) AS volume,
              coalesce(try_cast(string_split(line, ';')[4] AS DOUBLE), 0) AS cpc, CAST(0 AS DOUBLE) AS competition,
              CASE WHEN head LIKE '%Difficulty%' THEN coalesce(try_cast(string_split(line, ';')[5] AS DOUBLE), 0) ELSE 0 END AS difficulty,
              CAST(0 AS DOUBLE) AS traffic_percent
       FROM (SELECT report_id, string_split(body, chr(10))[1] AS head, unnest(string_split(body, chr(10))[2:]) AS line
             FROM {semrush_body} WHERE NOT starts_with(body, 'ERROR')) WHERE string_split(line, ';')[1] <> ''""",
)
def _(t):
    return providers.semrush_keywords(t.semrush_body)


# ── merges ───────────────────────────────────────────────────────────────────
@query("agg01_search_day_merge", "SELECT * FROM {gsc}")
def _(t):
    return gsc(t)


@query("agg02_analytics_day_merge", "SELECT * FROM {ga4}")
def _(t):
    return ga4(t)


@query("agg03_window_metrics", f"SELECT {METRIC_OUT} FROM {{page_metric}}")
def _(t):
    return metric_columns(page_metrics(t))


@query(
    "agg03_window_metrics_until",
    f"SELECT {METRIC_OUT} FROM (" + metrics_sql("{page}", "(DATE '2001-06-01' - 30)", "DATE '2001-06-20'").replace("{snapshot_newest}", f"""(SELECT * EXCLUDE (rn) FROM
        (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY date DESC, snapshot_id DESC) AS rn FROM {{semrush}} WHERE date >= DATE '2001-06-01' - 30) WHERE rn = 1)""") + ")",
)
def _(t):
    return metric_columns(page_metrics(t, today="2001-06-01", window_days=30, until="2001-06-20"))


common(
    "keyword_summary",
    f"""SELECT snapshot_id, page_id, count(*) AS organic_keywords, count(*) FILTER (WHERE position BETWEEN 4 AND 20) AS striking_distance_keywords,
          CAST(coalesce(sum(volume) FILTER (WHERE position BETWEEN 4 AND 20), 0) AS BIGINT) AS opportunity_volume,
          min(position) FILTER (WHERE position > 0) AS best_position, {r('avg(position) FILTER (WHERE position > 0)', 1)} AS average_position,
          {r('sum(volume * cpc) / 100', 2)} AS organic_cost
        FROM {{snapshot_keyword}} GROUP BY snapshot_id, page_id""",
)


@query("agg04_keyword_summary", "SELECT * FROM {keyword_summary}")
def _(t):
    return facts.keyword_summary(t.snapshot_keyword, ["snapshot_id", "page_id"])


# ── snapshots and queries ────────────────────────────────────────────────────
@query("jn06_newest_snapshot", "SELECT page_id, snapshot_id, date, organic_keywords, backlinks FROM {snapshot_newest}")
def _(t):
    rows = t.semrush.filter(metrics.window_filter(TODAY, 90))
    return metrics.newest_snapshot(rows).select("page_id", "snapshot_id", "date", "organic_keywords", "backlinks")


@query(
    "top05_snapshot_keywords",
    """SELECT snapshot_id, keyword, volume, position, rn AS keyword_rank FROM (
         SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY volume DESC, position, keyword) AS rn FROM {snapshot_keyword}) WHERE rn <= 3""",
)
def _(t):
    # Snapshots here hold at most seven keywords, so the check uses a smaller k than the default 25.
    return facts.top_keywords(t.snapshot_keyword, ["snapshot_id"], 3).select(
        "snapshot_id", "keyword", "volume", "position", "keyword_rank"
    )


@query(
    "top04_page_queries",
    """SELECT q.page_id, q.query, q.clicks, q.impressions, q.rn AS query_rank, n.date FROM (
         SELECT page_id, query, CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions,
                row_number() OVER (PARTITION BY page_id ORDER BY clicks DESC, impressions DESC, query) AS rn FROM {search_query}) q
       JOIN (SELECT page_id, max(date) AS date FROM {gsc} WHERE date BETWEEN DATE '2001-05-03' AND DATE '2001-08-01' GROUP BY page_id) n ON n.page_id = q.page_id
       WHERE q.rn <= 10""",
)
def _(t):
    out = facts.attach_queries(gsc(t), t.search_query, start="2001-05-03", end=TODAY)
    return out.select("page_id", "query", "clicks", "impressions", "query_rank", "date")


def snapshots_with_keywords(t):
    """Snapshots with their keyword array: at most the 25 stored keywords each."""
    top = facts.top_keywords(t.snapshot_keyword, ["snapshot_id", "page_id", "date"])
    k = F.struct("keyword_rank", "keyword", "position", "volume", "cpc", "difficulty")
    return top.groupBy("snapshot_id", "page_id", "date").agg(F.array_sort(F.collect_list(k)).alias("keywords"))


@query(
    "top06_striking_keywords",
    """SELECT site_id, page_id, url, keyword, position, volume, rn AS opportunity_rank FROM (
         SELECT p.site_id, k.page_id, p.url, k.keyword, k.position, k.volume,
                row_number() OVER (PARTITION BY p.site_id ORDER BY k.volume DESC, k.position, k.page_id, k.keyword) AS rn
         FROM {snapshot_keyword} k JOIN {page} p ON p.page_id = k.page_id
         JOIN (SELECT page_id, max_by(snapshot_id, struct_pack(d := date, s := snapshot_id)) AS snapshot_id FROM {snapshot_keyword} GROUP BY page_id) n ON n.snapshot_id = k.snapshot_id
         WHERE k.position BETWEEN 4 AND 20) WHERE rn <= 50""",
)
def _(t):
    out = facts.striking_keywords(snapshots_with_keywords(t), t.page, 50)
    return out.select("site_id", "page_id", "url", "keyword", "position", "volume", "opportunity_rank")


@query(
    "jn13_keyword_lookup",
    """SELECT page_id, snapshot_id, min(CAST(position AS INTEGER)) AS position FROM (
         SELECT k.page_id, k.snapshot_id, k.position, k.volume, row_number() OVER (PARTITION BY k.snapshot_id ORDER BY k.volume DESC, k.position, k.keyword) AS rn
         FROM {snapshot_keyword} k WHERE contains(lower(k.keyword), 'bolt')) WHERE rn = 1 GROUP BY ALL""",
)
def _(t):
    hit = F.filter("keywords", lambda k: F.lower(k["keyword"]).contains("bolt"))
    return snapshots_with_keywords(t).filter(F.size(hit) > 0).select("page_id", "snapshot_id", F.get(hit, F.lit(0))["position"].alias("position"))


# ── upserts and retention ────────────────────────────────────────────────────
VIEWS["gsc_update"] = """
    SELECT site_id, page_id, date, row_id, clicks + 1000 AS clicks, impressions FROM {gsc_raw} WHERE date >= DATE '2001-06-01' AND page_id % 3 = 0"""


@query(
    "snk01_fact_upsert",
    """SELECT * FROM (WITH u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id, date ORDER BY row_id DESC) AS rn FROM {gsc_update}) WHERE rn = 1)
       SELECT page_id, date, CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions FROM u
       UNION ALL SELECT page_id, date, clicks, impressions FROM {gsc} g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page_id = g.page_id AND u.date = g.date))""",
)
def _(t):
    target = gsc(t).select("page_id", "date", "clicks", "impressions")
    return facts.upsert(target, t.gsc_update.drop("site_id"), ["page_id", "date"], newest=["row_id"])


@query(
    "snk05_history_upsert",
    """SELECT * FROM (WITH h AS (SELECT site_id, CASE WHEN page_id % 40 = 0 THEN NULL ELSE page_id END AS page_id, date, 'page' AS scope, sum(clicks) AS clicks FROM {gsc} GROUP BY 1, 2, 3),
            u AS (SELECT DISTINCT site_id, page_id, date, scope, CAST(-1 AS BIGINT) AS clicks FROM h WHERE site_id <= 5)
       SELECT * FROM u UNION ALL SELECT site_id, page_id, date, scope, CAST(clicks AS BIGINT) FROM h
       WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.site_id = h.site_id AND u.page_id IS NOT DISTINCT FROM h.page_id AND u.date = h.date AND u.scope = h.scope))""",
)
def _(t):
    keys = ["site_id", "page_id", "date", "scope"]
    page = F.when(F.col("page_id") % 40 == 0, F.lit(None)).otherwise(F.col("page_id"))
    history = gsc(t).withColumns({"page_id": page, "scope": F.lit("page")}).groupBy(*keys).agg(F.sum("clicks").alias("clicks"))
    updates = history.filter("site_id <= 5").withColumn("clicks", F.lit(-1).cast("long"))
    return facts.upsert_nullsafe(history, updates, keys)


@query("snk06_retention_prune", f"SELECT page_id, date, clicks FROM {{gsc}} WHERE date >= DATE '{TODAY}' - 730")
def _(t):
    return facts.prune(gsc(t), today=TODAY).select("page_id", "date", "clicks")


# ── provider row to page ─────────────────────────────────────────────────────
VIEWS["provider_row"] = """
    SELECT e.event_id, p.site_id,
           CASE e.event_id % 7 WHEN 0 THEN concat(p.url, '/') WHEN 1 THEN replace(p.url, 'https://www.', 'http://') WHEN 2 THEN upper(p.path)
                WHEN 3 THEN concat(substr(p.path, 2), '?utm_source=x') WHEN 4 THEN concat(p.url, '?gclid=1#top') WHEN 5 THEN concat(p.path, '/none')
                ELSE '' END AS raw_url
    FROM {events} e JOIN {page} p ON p.page_id = e.user_id * 13"""
VIEWS["site_root"] = "SELECT site_id, concat('https://', domain, '/') AS base_url FROM {site}"

common(
    "provider_match",
    """SELECT e.event_id, e.site_id, e.raw_url, p.page_id FROM {provider_row} e LEFT JOIN {page} p
         ON p.site_id = e.site_id AND raw_url <> ''
        AND p.path = rtrim(lower(regexp_replace(CASE WHEN starts_with(raw_url, 'http') OR starts_with(raw_url, '/') THEN raw_url ELSE '/' || raw_url END, '^https?://[^/]*|[?#].*$', '', 'g')), '/')""",
)


@query("jn01_page_resolution", "SELECT event_id, site_id, raw_url, page_id FROM {provider_match}")
def _(t):
    resolved = resolve.resolve_pages(t.provider_row, t.page, t.site_root)
    return t.provider_row.join(resolved.drop("matched_by"), ["site_id", "raw_url"], "left").select(
        "event_id", "site_id", "raw_url", "page_id"
    )


@query(
    "agg24_match_report",
    """SELECT t.site_id, t.matched, t.unmatched, u.s AS unmatched_samples FROM
         (SELECT site_id, count(*) FILTER (WHERE page_id IS NOT NULL) AS matched, count(*) FILTER (WHERE page_id IS NULL) AS unmatched FROM {provider_match} GROUP BY site_id) t
       LEFT JOIN (SELECT site_id, string_agg(raw_url, '|' ORDER BY raw_url) AS s FROM (
             SELECT site_id, raw_url, row_number() OVER (PARTITION BY site_id ORDER BY raw_url) AS rn
             FROM (SELECT DISTINCT site_id, raw_url FROM {provider_match} WHERE page_id IS NULL)) WHERE rn <= 10 GROUP BY site_id) u ON u.site_id = t.site_id""",
)
def _(t):
    resolved = resolve.resolve_pages(t.provider_row, t.page, t.site_root)
    report = resolve.match_report(t.provider_row, resolved)
    return report.withColumn("unmatched_samples", F.array_join("unmatched_samples", "|"))
