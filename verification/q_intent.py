"""Intent classification, keyword tiers, mismatches and cannibalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.functions import intent as ix
from siteledger.functions import keywords as kx
from siteledger.functions.numeric import rnd
from siteledger.plans import intent as plan
from siteledger.plans.impact import with_site_totals

from .q_facts import page_metrics
from .q_impact import LEAD, PATTERNS, RELEVANCE, TRAFFIC, q
from .registry import common, query, r
from .views import VIEWS

VIEWS.update(
    {
        "intent_page": """
            SELECT p_partkey AS page_id, CAST(substr(p_brand, 7) AS INT) AS site_id,
                   concat('https://www.site', CAST(substr(p_brand, 7) AS INT), '.test', split_part('/checkout,/blog,/compare,/store,/about,/x,/best-of,/wares', ',', CAST(1 + p_partkey % 8 AS INT)),
                          CASE WHEN p_partkey % 50 = 7 THEN '' ELSE concat('/', replace(p_name, ' ', '-'), '-', p_partkey) END) AS url,
                   concat('/', p_name, '-', p_partkey) AS path,
                   CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat(split_part('Buy the,Best,How to choose a,Cheap,Directions to,Our,Review of,What is a', ',', CAST(1 + p_partkey % 8 AS INT)), ' ', p_name) END AS title,
                   CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE concat(split_part('Order,Compare,Learn about,Near,Guide to', ',', CAST(1 + p_partkey % 5 AS INT)), ' ', lower(p_type)) END AS h1,
                   CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(split_part('What is new in,Buy now:,Compare all,Near me:,Guide for', ',', CAST(1 + (p_partkey * 7) % 5 AS INT)), ' ', p_name, '|', split_part('Prices and offers of,How it works with,Local store of', ',', CAST(1 + p_partkey % 4 % 3 AS INT)), ' ', lower(p_type)) END AS headings_text,
                   d.text AS content, split_part('Offer,Article,Hotel,FAQPage,Thing,Thing,Thing,Thing,Event,Thing,Thing', ',', CAST(1 + p_partkey % 11 AS INT)) AS schema_type,
                   concat(p_name, '|', p_size) AS content_key, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(200 - p_size * 3 AS DOUBLE) / 2 END AS seo_score
            FROM {part} LEFT JOIN {documents} d ON d.doc_id = p_partkey""",
        "intent_query": """
            SELECT page_id, query, clicks, impressions, position, CAST(rn AS INT) AS query_rank FROM (
              SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY clicks DESC, impressions DESC, query) AS rn FROM (
                SELECT CASE WHEN l_partkey % 6 = 5 THEN l_partkey + 1000000000 ELSE l_partkey END AS page_id, concat(split_part('buy |best |how to use |directions |login |what is |the |cheap ', '|', CAST(1 + (l_suppkey + l_partkey % 3) % 8 AS INT)), p_name, ' ', lower(p_type)) AS query,
                       CAST(SUM(floor(l_quantity * round(l_discount * 100) / 10)) AS BIGINT) AS clicks, CAST(SUM(l_quantity * 10) AS BIGINT) AS impressions, MIN(CAST(10 + l_orderkey % 300 AS DOUBLE) / 10) AS position
                FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2) a) b""",
        "snapshot_list": """
            SELECT page_id, keyword, position, volume, difficulty, CAST(rn - 1 AS INT) AS idx FROM (
              SELECT k.*, row_number() OVER (PARTITION BY k.page_id ORDER BY k.volume DESC, k.position, k.keyword) AS rn
              FROM {snapshot_keyword} k JOIN (SELECT page_id, max(snapshot_id) AS snapshot_id FROM {snapshot_keyword} GROUP BY page_id) n ON n.snapshot_id = k.snapshot_id) x""",
        "suggestion": """
            SELECT page_id, keyword, tier, CAST(rn - 1 AS INT) AS idx FROM (
              SELECT l_partkey AS page_id, concat(' ', p_name, ' ', CASE WHEN l_suppkey % 3 = 0 THEN 'How ' ELSE '' END, l_suppkey % 50) AS keyword, split_part('primary|semantic|none|Long Tail|', '|', CAST(1 + l_suppkey % 5 AS INT)) AS tier,
                     row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_extendedprice) AS rn
              FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) a""",
        "ai_finding": """
            SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN split_part('commercial,local,transactional', ',', CAST(1 + p_partkey % 2 AS INT)) END AS ai_intent,
                   CASE WHEN p_partkey % 2 = 0 THEN CAST(0.65 AS DOUBLE) END AS ai_confidence FROM {part} WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    }
)

TOKENS = lambda x: f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"
starts = lambda x, stems: f"regexp_matches(lower({x}), '(^|\\s)({'|'.join(stems)})')"
inlist = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
GUESS = lambda x: f"""CASE WHEN coalesce({TOKENS(x)}[1] IN {inlist(kx.QUESTION_WORDS)}, FALSE) THEN 'informational' WHEN contains(lower({x}), 'near me') OR {starts(x, kx.LOCAL_STEMS)} THEN 'local'
   WHEN {starts(x, kx.TRANSACTIONAL_STEMS)} THEN 'transactional' WHEN {starts(x, kx.COMMERCIAL_STEMS)} THEN 'commercial' ELSE 'informational' END"""


def lits(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


# Rule, statistical and final intent.
_rule = [(f"schema_type_l IN {inlist(ts)}", i, c) for ts, i, c in ix.SCHEMA_INTENTS]
_rule += [(f"regexp_matches(lower(url), {q(p)})", i, c) for i, c, p in ix.URL_BANKS]
_rule += [("rtrim(regexp_replace(lower(url), 'https?://[^/]+', ''), '/') = ''", "navigational", 0.80)]
common(
    "rule_intent",
    "SELECT *, CASE " + " ".join(f"WHEN {c} THEN '{i}'" for c, i, _ in _rule) + " END AS rule_intent, CASE " + " ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, _, v in _rule)
    + " END AS rule_confidence FROM (SELECT *, lower(schema_type) AS schema_type_l FROM {intent_page})",
)
_hits = {i: f"list_has_any({TOKENS('query')}, {lits(list(t))})" + "".join(f" OR contains(lower(query), {q(p)})" for p in ps) for i, (t, ps) in ix.QUERY_BANKS.items()}
_sums = ", ".join(f"sum(CASE WHEN {h} THEN w ELSE 0 END) AS s_{i}" for i, h in _hits.items())
_best = "greatest(" + ", ".join(f"s_{i}" for i in _hits) + ")"
common(
    "stat_intent",
    f"""SELECT page_id, CASE {' '.join(f"WHEN s_{i} = {_best} THEN '{i}'" for i in _hits)} END AS stat_intent, {r(f'least(0.92, 0.5 + {_best} / total * 0.6)', 3)} AS stat_confidence
        FROM (SELECT page_id, sum(w) AS total, {_sums} FROM (SELECT *, CASE WHEN impressions = 0 THEN 1 ELSE impressions END AS w FROM {{intent_query}}) GROUP BY page_id) WHERE {_best} > 0""",
)
common(
    "intent_final",
    """SELECT p.*, s.stat_intent, s.stat_confidence, f.ai_intent, coalesce(rule_intent, intent) AS business_intent FROM (
         SELECT p.*, CASE WHEN rule_confidence >= 0.75 THEN rule_intent WHEN stat_confidence >= 0.75 THEN stat_intent WHEN ai_intent IS NOT NULL THEN ai_intent WHEN stat_intent IS NOT NULL THEN stat_intent ELSE 'informational' END AS intent,
                CASE WHEN rule_confidence >= 0.75 THEN rule_confidence WHEN stat_confidence >= 0.75 THEN stat_confidence WHEN ai_intent IS NOT NULL THEN coalesce(ai_confidence, 0.70) WHEN stat_intent IS NOT NULL THEN stat_confidence ELSE 0.40 END AS confidence,
                CASE WHEN rule_confidence >= 0.75 THEN 'rules' WHEN stat_confidence >= 0.75 THEN 'statistical' WHEN ai_intent IS NOT NULL THEN 'ai' WHEN stat_intent IS NOT NULL THEN 'statistical' ELSE 'rules' END AS method
         FROM {rule_intent} p LEFT JOIN {stat_intent} USING (page_id) LEFT JOIN {ai_finding} USING (page_id)) p
       LEFT JOIN {stat_intent} s USING (page_id) LEFT JOIN {ai_finding} f USING (page_id)""",
)


def weigh_sql(stems, phrases, schema, priors) -> str:
    parts = ["CASE intent " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in priors.items()) + " ELSE 0 END", f"CASE WHEN schema_type_l IN {inlist(schema)} THEN 2.0 ELSE 0 END"]
    parts += [f"CASE WHEN regexp_matches(prom, '(^|[^a-z]){s}') THEN 1.5 WHEN regexp_matches(body, '(^|[^a-z]){s}') THEN 0.25 ELSE 0 END" for s in stems]
    parts += [f"CASE WHEN contains(prom, '{p}') THEN 1.0 WHEN contains(body, '{p}') THEN 0.2 ELSE 0 END" for p in phrases]
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


_com = weigh_sql(ix.COMMERCIAL_STEMS, ix.COMMERCIAL_PHRASES, ix.COMMERCIAL_SCHEMA, {"transactional": 2.0, "commercial": 2.0, "local": 1.0})
_inf = weigh_sql(ix.INFORMATIONAL_STEMS, ix.INFORMATIONAL_PHRASES, ix.INFORMATIONAL_SCHEMA, {"informational": 2.0})
common(
    "page_type",
    f"""SELECT *, CASE WHEN com + inf <= 0 THEN 'informational' WHEN com / (com + inf) >= 0.65 THEN 'commercial' WHEN com / (com + inf) <= 0.35 THEN 'informational' ELSE 'hybrid' END AS page_type FROM (
          SELECT *, {_com} AS com, {_inf} AS inf FROM (SELECT *, lower(concat_ws(' ', title, h1)) AS prom, lower(coalesce(content, '')) AS body FROM {{intent_final}}))""",
)
# Targeting: the first fragment weighs 3, the second 2, every other 1; the heaviest intent wins, on a tie the one named first.
common(
    "targeting",
    f"""SELECT page_id, target_intent, {r('least(0.80, 0.45 + w / total * 0.45)', 3)} AS target_confidence FROM (
          SELECT *, sum(w) OVER (PARTITION BY page_id) AS total, row_number() OVER (PARTITION BY page_id ORDER BY w DESC, i) AS rn FROM (
            SELECT page_id, {GUESS('f')} AS target_intent, sum(CASE i WHEN 1 THEN 3.0 WHEN 2 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, min(i) AS i FROM (
              SELECT page_id, unnest(frs) AS f, generate_subscripts(frs, 1) AS i FROM (
                SELECT page_id, list_filter(list_concat([title, h1], string_split(headings_text, '|')), lambda x: x IS NOT NULL AND x <> '') AS frs FROM {{intent_page}})) GROUP BY ALL)) WHERE rn = 1""",
)
_sev = "CASE " + " ".join(f"WHEN business_intent = '{b}' AND o = '{o}' THEN '{v}'" for (b, o), v in ix.MISMATCH.items()) + " END"


# Chained concat instead of replace keeps the braces out of the SQL text.
def concat_sql(template: str) -> str:
    import re

    parts = re.split(r"(\{[bqse]\})", template)
    names = {"{b}": "business_intent", "{q}": "o", "{s}": "subject", "{e}": "evidence"}
    return "concat(" + ", ".join(names.get(p, q(p)) for p in parts if p) + ")"


_expl = " ".join(f"WHEN business_intent = '{b}' AND o = '{o}' THEN {concat_sql(t)}" for (b, o), t in ix.EXPLANATIONS.items())
common(
    "mismatch",
    f"""SELECT *, CASE WHEN o IS NULL THEN {q(ix.NO_EVIDENCE)} WHEN severity IS NULL THEN concat('Business intent (', business_intent, ') aligns with observed intent (', o, ').') {_expl}
          ELSE {concat_sql(ix.DEFAULT_EXPLANATION)} END AS explanation FROM (
        SELECT *, {_sev} AS severity, CASE WHEN src = 'gsc_queries' THEN 'the top queries reaching it' ELSE 'its own title and headings' END AS subject,
          CASE WHEN src = 'gsc_queries' THEN tq ELSE coalesce(nullif(concat_ws(', ', '"' || title[1:70] || '"', '"' || h1[1:70] || '"'), ''), 'its current title and headings') END AS evidence FROM (
        SELECT p.*, t.target_intent, CASE WHEN stat_confidence >= 0.55 THEN stat_intent WHEN target_confidence >= 0.55 THEN target_intent END AS o,
          CASE WHEN stat_confidence >= 0.55 THEN stat_confidence WHEN target_confidence >= 0.55 THEN target_confidence ELSE 0 END AS o_confidence,
          CASE WHEN stat_confidence >= 0.55 THEN 'gsc_queries' WHEN target_confidence >= 0.55 THEN 'page_targeting' ELSE 'none' END AS src, x.tq
        FROM {{intent_final}} p LEFT JOIN {{targeting}} t USING (page_id)
        LEFT JOIN (SELECT page_id, string_agg('"' || query || '"', ', ' ORDER BY query_rank) AS tq FROM {{intent_query}} WHERE query_rank <= 3 GROUP BY page_id) x USING (page_id)))""",
)
# Keywords.
common(
    "keyword_source",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id, keyword ORDER BY o, idx) AS rn FROM (
         SELECT page_id, lower(trim(query)) AS keyword, 'gsc' AS source, 0 AS o, query_rank - 1 AS idx, position, impressions, CAST(impressions AS DOUBLE) AS base, CAST(NULL AS DOUBLE) AS difficulty, NULL AS given FROM {intent_query}
         UNION ALL SELECT page_id, lower(trim(keyword)), 'semrush', 1, idx, CAST(position AS DOUBLE), NULL, volume * 30.0, difficulty, NULL FROM {snapshot_list}
         UNION ALL SELECT page_id, lower(trim(keyword)), 'ai', 2, idx, NULL, NULL, NULL, NULL, tier FROM {suggestion}) WHERE keyword <> '') WHERE rn = 1""",
)
TIER = f"""CASE WHEN source = 'ai' AND replace(lower(given), ' ', '_') IN {inlist(kx.TIER_CAPS)} THEN replace(lower(given), ' ', '_')
   WHEN coalesce({TOKENS('keyword')}[1] IN {inlist(kx.QUESTION_WORDS)}, FALSE) THEN 'question' WHEN (source <> 'ai' AND idx < 2) OR (source = 'ai' AND idx = 0) THEN 'primary'
   WHEN len({TOKENS('keyword')}) >= 3 THEN 'long_tail' WHEN source = 'ai' THEN 'semantic' ELSE 'secondary' END"""
RANKING = """CASE WHEN source = 'ai' THEN 0.65 WHEN position IS NULL THEN 0.5 WHEN position <= 3 THEN 0.10 WHEN position <= 10 THEN 0.70 + (10 - position) * 0.03 WHEN position <= 20 THEN 0.55 + (20 - position) * 0.015
   WHEN position <= 50 THEN 0.30 + (50 - position) * 0.005 ELSE 0.15 END"""
DEMAND = "CASE WHEN source = 'ai' THEN 0.55 WHEN coalesce(base, 0) <= 0 THEN 0.30 ELSE least(1.0, log10(base + 1) / 4) END"
COMPETITION = """CASE WHEN difficulty IS NOT NULL THEN least(1.0, greatest(0.05, 1 - difficulty / 100)) WHEN position > 0 AND position <= 10 THEN 0.85 WHEN position > 0 AND position <= 30 THEN 0.65
   WHEN position > 0 THEN 0.45 WHEN impressions > 0 THEN 0.55 ELSE 0.40 END"""
MATCH = "CASE WHEN guess = intent THEN 1.0 " + " ".join(f"WHEN (guess = '{a}' AND intent = '{b}') OR (guess = '{b}' AND intent = '{a}') THEN {v}" for (a, b), v in kx.ADJACENT_INTENTS.items()) + " ELSE 0.30 END"
_terms = f"list_filter({TOKENS('keyword')}, lambda w: len(w) > 2)"
RELEVANT = f"""CASE WHEN len({_terms}) = 0 THEN 0.5 ELSE least(1.0, greatest(0.05, (coalesce(list_sum(list_transform({_terms}, lambda w: CASE WHEN contains(lt, w) THEN 0.40::DOUBLE WHEN contains(lh, w) THEN 0.30::DOUBLE WHEN contains(lhd, w) THEN 0.18::DOUBLE WHEN contains(lb, w) THEN 0.10::DOUBLE ELSE 0::DOUBLE END)), 0)
   + CASE WHEN contains(lt, keyword) OR contains(lh, keyword) THEN 0.35 WHEN contains(lb, keyword) THEN 0.15 ELSE 0 END) / len({_terms}) + CASE WHEN contains(lb, keyword) THEN 0.15 ELSE 0 END)) END"""
common(
    "intent_relevance",
    f"SELECT page_id, CAST({RELEVANCE} AS DOUBLE) AS relevance FROM (SELECT p.page_id, p.path, m.* EXCLUDE (page_id, path) FROM {{intent_page}} p JOIN (SELECT *, sum(revenue) OVER (PARTITION BY site_id) AS site_revenue, sum(conversions) OVER (PARTITION BY site_id) AS site_conversions FROM {{page_metric}}) m USING (page_id))",
)
common(
    "keyword_scored",
    f"""SELECT *, {r('least(100, pow(demand_score * ranking_opportunity_score * intent_match_score * business_relevance_score * content_relevance_score * competition_opportunity_score, 1 / 6::DOUBLE) * 100)', 1)} AS keyword_opportunity_score FROM (
        SELECT site_id, page_id, keyword, source, o, idx, {TIER} AS keyword_tier, CAST({DEMAND} AS DOUBLE) AS demand_score, CAST({RANKING} AS DOUBLE) AS ranking_opportunity_score, CAST({MATCH} AS DOUBLE) AS intent_match_score,
          relevance AS business_relevance_score, CAST({RELEVANT} AS DOUBLE) AS content_relevance_score, CAST({COMPETITION} AS DOUBLE) AS competition_opportunity_score, position AS current_position, impressions AS current_impressions FROM (
        SELECT k.*, p.site_id, p.intent, v.relevance, {GUESS('k.keyword')} AS guess, lower(coalesce(title, '')) AS lt, lower(coalesce(h1, '')) AS lh, lower(replace(headings_text, '|', ' ')) AS lhd, lower(coalesce(content, '')) AS lb
        FROM {{keyword_source}} k JOIN {{intent_final}} p USING (page_id) JOIN {{intent_relevance}} v USING (page_id)))""",
)
_caps = "CASE keyword_tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in kx.TIER_CAPS.items()) + " END"
common(
    "keyword_ranked",
    "SELECT *, row_number() OVER (PARTITION BY page_id, keyword_tier ORDER BY keyword_opportunity_score DESC, o, idx) AS tier_rank FROM {keyword_scored}",
)
common("keyword_capped", f"SELECT * FROM {{keyword_ranked}} WHERE tier_rank <= {_caps}")
common(
    "keyword_page",
    f"""SELECT page_id, {r('avg(keyword_opportunity_score) FILTER (WHERE rn <= 3)', 1)} AS keyword_opportunity_score, string_agg(keyword, '|' ORDER BY tier_rank) FILTER (WHERE keyword_tier = 'primary' AND tier_rank <= 3) AS primary_keywords,
          string_agg(keyword, '|' ORDER BY tier_rank) FILTER (WHERE keyword_tier = 'secondary' AND tier_rank <= 5) AS secondary_keywords
        FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY keyword_opportunity_score DESC, keyword) AS rn FROM {{keyword_ranked}}) GROUP BY page_id""",
)
common(
    "intent_profile",
    f"""SELECT *, {LEAD} AS lead_potential_score FROM (SELECT *, {TRAFFIC} AS traffic_potential_score FROM (
        SELECT i.page_id, i.site_id, i.intent AS detected_intent, i.confidence AS intent_confidence, i.method AS detection_method, i.business_intent, t.page_type, i.severity IS NOT NULL AS intent_mismatch, i.severity AS mismatch_severity,
          i.explanation AS mismatch_explanation, i.o AS query_intent, coalesce(k.keyword_opportunity_score, 0) AS keyword_opportunity_score, k.primary_keywords, k.secondary_keywords, i.content_key,
          i.seo_score, i.path, m.clicks, m.impressions, m.position, m.sessions, m.conversions, m.revenue, m.engagement_rate, m.site_revenue, m.site_conversions, m.target, m.raw_ctr
        FROM {{mismatch}} i JOIN {{page_type}} t USING (page_id) LEFT JOIN {{keyword_page}} k USING (page_id)
        JOIN (SELECT *, sum(revenue) OVER (PARTITION BY site_id) AS site_revenue, sum(conversions) OVER (PARTITION BY site_id) AS site_conversions, CAST({{ctr_b}} AS DOUBLE) AS target, CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END AS raw_ctr FROM {{page_metric}}) m USING (page_id)))""".replace(
        "{ctr_b}", __import__("verification.q_impact", fromlist=["CTR_B"]).CTR_B
    ),
)


# ── Spark side ───────────────────────────────────────────────────────────────
def text_pages(t):
    # By page, as the join with the texts leaves the rows and every join after it wants them: texts are shuffled once.
    return t.intent_page.repartition("page_id").withColumns(
        {"structured_data_types": F.array("schema_type"), "content_hash": F.sha2("content_key", 256), "headings": F.filter(F.split("headings_text", r"\|"), lambda h: h != "")}
    ).drop("schema_type", "content_key", "headings_text")


def classified(t):
    return plan.classify(text_pages(t), t.intent_query, t.ai_finding)


def pages_with_metrics(t):
    keep = ["page_id", "clicks", "impressions", "position", "sessions", "conversions", "revenue", "engagement_rate", "site_revenue", "site_conversions"]
    return text_pages(t).join(with_site_totals(page_metrics(t)).select(*keep), "page_id")


def sources(t):
    queries = t.intent_query.withColumn("idx", F.col("query_rank") - 1)
    return plan.keyword_sources(queries, t.snapshot_list, t.suggestion)


def built(t, existing=None):
    queries = t.intent_query.withColumn("idx", F.col("query_rank") - 1)
    return plan.intent_profiles(pages_with_metrics(t), queries, t.snapshot_list, t.ai_finding, t.suggestion, existing, PATTERNS, keep_keywords=False)


def scored(t):
    pages = pages_with_metrics(t).join(classified(t).select("page_id", F.col("intent.intent").alias("detected_intent")), "page_id")
    return plan.score_keywords(sources(t), pages.withColumn("business_relevance", plan.business_relevance(patterns=PATTERNS)))


@query("scl10_keyword_intent_guess", f"SELECT page_id, query, {GUESS('query')} AS guess FROM {{intent_query}}")
def _(t):
    return t.intent_query.select("page_id", "query", kx.intent_guess("query").alias("guess"))


@query("scl60_rule_intent", "SELECT page_id, rule_intent AS intent, rule_confidence AS confidence FROM {rule_intent}")
def _(t):
    v = ix.rule_intent("url", F.col("structured_data_types"))
    return text_pages(t).select("page_id", v["intent"].alias("intent"), v["confidence"].alias("confidence"))


@query("scl61_statistical_intent", "SELECT page_id, stat_intent AS intent, stat_confidence AS confidence FROM {stat_intent}")
def _(t):
    return ix.statistical_intents(t.intent_query).select("page_id", "statistical.intent", "statistical.confidence")


@query("scl62_tiered_intent", "SELECT page_id, intent, CAST(confidence AS DOUBLE) AS confidence, method, business_intent FROM {intent_final}")
def _(t):
    return classified(t).select("page_id", "intent.intent", "intent.confidence", "intent.method", "business_intent")


@query("scl63_page_type", "SELECT page_id, page_type FROM {page_type}")
def _(t):
    return classified(t).select("page_id", "page_type")


@query("scl64_targeting_intent", "SELECT page_id, target_intent AS intent, target_confidence AS confidence FROM {targeting}")
def _(t):
    v = ix.targeting_intent(F.col("title"), F.col("h1"), F.col("headings"))
    return text_pages(t).withColumn("v", v).filter("v is not null").select("page_id", "v.intent", "v.confidence")


@query(
    "scl65_intent_mismatch",
    "SELECT page_id, severity, o AS query_intent, CAST(o_confidence AS DOUBLE) AS confidence, src AS evidence_source, explanation FROM {mismatch}",
)
def _(t):
    return classified(t).select("page_id", "mismatch.severity", "mismatch.query_intent", "mismatch.confidence", "mismatch.evidence_source", "mismatch.explanation")


@query("set01_keyword_sources", "SELECT page_id, keyword, source, idx, position, impressions FROM {keyword_source}")
def _(t):
    return sources(t).select("page_id", "keyword", "source", "idx", "position", "impressions")


@query(
    "win06_keyword_list_position",
    "SELECT snapshot_id, keyword, CAST(rn - 1 AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY volume DESC, position, keyword) AS rn FROM {snapshot_keyword})",
)
def _(t):
    from .q_facts import snapshots_with_keywords

    return snapshots_with_keywords(t).select("snapshot_id", F.posexplode("keywords")).select("snapshot_id", F.col("col.keyword").alias("keyword"), F.col("pos").alias("idx"))


FACTORS = "demand_score ranking_opportunity_score intent_match_score business_relevance_score content_relevance_score competition_opportunity_score".split()


@query("scl40_keyword_factors", "SELECT page_id, keyword, " + ", ".join(f"{r(f, 6)} AS {f}" for f in FACTORS) + " FROM {keyword_scored}")
def _(t):
    return scored(t).select("page_id", "keyword", *[rnd(f, 6).alias(f) for f in FACTORS])


@query("scl41_composite_keyword_score", "SELECT page_id, keyword, keyword_opportunity_score FROM {keyword_scored}")
def _(t):
    return scored(t).select("page_id", "keyword", "keyword_opportunity_score")


@query("scl42_keyword_tier", f"SELECT page_id, keyword, {TIER} AS keyword_tier FROM {{keyword_source}}")
def _(t):
    given = F.replace(F.lower("given_tier"), F.lit(" "), F.lit("_"))
    tier = F.when((F.col("source") == "ai") & given.isin(list(kx.TIER_CAPS)), given).otherwise(kx.assign_tier("keyword", "idx", "source"))
    return sources(t).select("page_id", "keyword", tier.alias("keyword_tier"))


@query("top07_tier_caps", "SELECT page_id, keyword, keyword_tier, tier_rank FROM {keyword_capped}")
def _(t):
    return plan.ranked_keywords(scored(t), kx.TIER_CAPS).select("page_id", "keyword", "keyword_tier", "tier_rank")


@query("win10_page_keyword_score", "SELECT page_id, keyword_opportunity_score, primary_keywords FROM {keyword_page}")
def _(t):
    out = plan.page_keyword_scores(plan.ranked_keywords(scored(t)))
    primary = F.nullif(F.array_join("primary_keywords", "|"), F.lit(""))
    return out.select("page_id", "keyword_opportunity_score", primary.alias("primary_keywords"))


PROFILE = """page_id, site_id, detected_intent, intent_confidence, detection_method, business_intent, page_type, intent_mismatch, mismatch_severity, mismatch_explanation,
  query_intent, keyword_opportunity_score, traffic_potential_score, lead_potential_score"""


@query("pipe03_intent_profiles", f"SELECT {PROFILE.replace('intent_confidence,', 'CAST(intent_confidence AS DOUBLE) AS intent_confidence,')}, secondary_keywords FROM {{intent_profile}}")
def _(t):
    profiles, _ = built(t)
    secondary = F.nullif(F.array_join("secondary_keywords", "|"), F.lit(""))
    return profiles.select(*[c.strip() for c in PROFILE.split(",")], secondary.alias("secondary_keywords"))


VIEWS["existing_profile"] = """
    SELECT p_partkey AS page_id, concat(p_name, '|', CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 1 END) AS content_key FROM {part} WHERE p_partkey % 2 = 0"""


@query("pipe03_changed_pages_only", "SELECT page_id FROM {intent_page} p WHERE NOT EXISTS (SELECT 1 FROM {existing_profile} e WHERE e.page_id = p.page_id AND e.content_key = p.content_key)")
def _(t):
    existing = t.existing_profile.select("page_id", F.sha2("content_key", 256).alias("content_hash"))
    return plan.changed_pages(text_pages(t), existing).select("page_id")


# Keyword rows for the site-wide operators: many pages share a keyword.
VIEWS["keyword_row"] = """
    SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(substr(p_brand, 7) AS INT) AS site_id, l_partkey AS page_id, concat(p_name, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE concat(' ', lower(p_type)) END) AS keyword,
           split_part('primary,secondary,long_tail', ',', CAST(1 + l_suppkey % 3 AS INT)) AS keyword_tier, CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST((l_orderkey * 7 + l_suppkey) % 1000 AS DOUBLE) / 10 END AS keyword_opportunity_score,
           CAST(l_suppkey % 10 AS DOUBLE) / 10 AS demand_score, CASE WHEN l_partkey % 3 = 0 THEN CAST(1 + l_orderkey % 30 AS DOUBLE) END AS current_position, split_part('gsc,semrush,ai', ',', CAST(1 + l_linenumber % 3 AS INT)) AS source
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
common(
    "best_keyword_row",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site_id, keyword, keyword_tier, page_id ORDER BY coalesce(keyword_opportunity_score, 0) DESC, coalesce(current_position, 9999), source, keyword_opportunity_score DESC NULLS LAST, row_id) AS rn FROM {keyword_row}) WHERE rn = 1",
)
common(
    "cannibal_group",
    """SELECT site_id, keyword, keyword_tier, count(*) AS page_count, max(coalesce(keyword_opportunity_score, 0)) AS best_score,
         CASE WHEN count(current_position) >= 2 THEN CASE WHEN count(*) FILTER (WHERE current_position <= 10) >= 2 THEN 'P0' ELSE 'P1' END WHEN count(current_position) = 1 THEN 'P2' ELSE 'P3' END AS severity,
         arg_min(page_id, rk) AS canonical_page_id, arg_min(url, rk) AS canonical_url, max(CASE WHEN current_position IS NOT NULL THEN url END) AS visible
       FROM (SELECT k.*, p.url, row_number() OVER (PARTITION BY k.site_id, keyword, keyword_tier ORDER BY coalesce(keyword_opportunity_score, -1) DESC, coalesce(current_position, 9999), k.page_id) AS rk
             FROM {best_keyword_row} k JOIN {page} p USING (page_id) WHERE keyword_tier IN ('primary', 'secondary')) GROUP BY site_id, keyword, keyword_tier HAVING count(*) >= 2""",
)
common(
    "cannibal_text",
    """SELECT g.*, concat('"', g.keyword, '" is targeted as a ', g.keyword_tier, ' keyword by ', page_count, ' pages on this site (', canonical_url, ' and ', o.others, CASE WHEN page_count - 21 > 0 THEN concat(' and ', page_count - 21, ' more') ELSE '' END, '). ',
        CASE severity WHEN 'P0' THEN 'Both pages currently rank in the top 10 for this term, which means Google is actively splitting authority between them and can swap which one it shows on any given crawl.'
          WHEN 'P1' THEN 'Both pages currently rank for this term, diluting the ranking signal that would otherwise concentrate on a single page.'
          WHEN 'P2' THEN concat(visible, ' already ranks for this term; the other page targets the same keyword without yet showing up in search, so it is a duplicate target rather than a proven competitor — fix it before it starts competing for real.')
          ELSE concat('Neither page currently ranks for this term, but both are written to target it as a ', g.keyword_tier, ' keyword — worth resolving before either one starts ranking and the two begin competing.') END,
        ' Recommended fix: consolidate on ', canonical_url, ' as the canonical target — update its content to fully cover the term, and either 301-redirect, canonicalise, or re-target the competing page(s) to a different keyword.') AS explanation
      FROM {cannibal_group} g JOIN (SELECT site_id, keyword, keyword_tier, string_agg(url, ', ' ORDER BY rn) AS others FROM (
          SELECT k.site_id, k.keyword, k.keyword_tier, p.url, row_number() OVER (PARTITION BY k.site_id, k.keyword, k.keyword_tier ORDER BY coalesce(k.keyword_opportunity_score, 0) DESC, k.page_id) AS rn
          FROM {best_keyword_row} k JOIN {page} p USING (page_id) JOIN {cannibal_group} g ON g.site_id = k.site_id AND g.keyword = k.keyword AND g.keyword_tier = k.keyword_tier WHERE k.page_id <> g.canonical_page_id)
        WHERE rn <= 20 GROUP BY ALL) o ON o.site_id = g.site_id AND o.keyword = g.keyword AND o.keyword_tier = g.keyword_tier""",
)


@query("pipe04_cannibalization_groups", "SELECT site_id, keyword, keyword_tier, severity, page_count, best_score, canonical_page_id, canonical_url, explanation FROM {cannibal_text}")
def _(t):
    return plan.cannibalization(t.keyword_row, t.page)[0]


@query(
    "pipe04_cannibalization_members",
    "SELECT k.site_id, k.keyword, k.keyword_tier, k.page_id, k.keyword_opportunity_score, k.current_position, g.severity FROM {best_keyword_row} k JOIN {cannibal_group} g ON g.site_id = k.site_id AND g.keyword = k.keyword AND g.keyword_tier = k.keyword_tier",
)
def _(t):
    members = plan.cannibalization(t.keyword_row, t.page)[1]
    return members.select("site_id", "keyword", "keyword_tier", "page_id", "keyword_opportunity_score", "current_position", "severity")


@query("win07_best_keyword_row", "SELECT site_id, keyword, keyword_tier, page_id, keyword_opportunity_score FROM {best_keyword_row}")
def _(t):
    return plan.best_row_per_page(t.keyword_row).select("site_id", "keyword", "keyword_tier", "page_id", "keyword_opportunity_score")


@query(
    "jn15_touched_keyword_groups",
    "SELECT row_id FROM {keyword_row} k WHERE EXISTS (SELECT 1 FROM {keyword_row} x WHERE x.site_id = k.site_id AND x.keyword = k.keyword AND x.keyword_tier = k.keyword_tier AND x.page_id % 20 = 3)",
)
def _(t):
    return plan.touched_groups(t.keyword_row, t.page.filter("page_id % 20 = 3")).select("row_id")


VIEWS["payload_finding"] = """
    SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN 'search_intent_mismatch' ELSE 'title' END AS issue, concat('old text ', p_partkey) AS explanation FROM {part} WHERE p_partkey % 2 = 0"""


@query(
    "pipe15_mismatch_finding_merge",
    """SELECT f.page_id, CASE WHEN NOT coalesce(p.intent_mismatch, FALSE) THEN concat(f.issue, '=', f.explanation) WHEN f.issue = 'search_intent_mismatch' THEN concat(f.issue, '=', p.mismatch_explanation)
          ELSE concat('search_intent_mismatch=', p.mismatch_explanation, '|', f.issue, '=', f.explanation) END AS findings,
         CASE WHEN p.intent_mismatch THEN split_part('critical,high,medium,low', ',', CAST(substr(p.mismatch_severity, 2) AS INTEGER) + 1) ELSE 'low' END AS first_priority, coalesce(p.intent_mismatch, FALSE) AS intent_mismatch, CASE WHEN p.intent_mismatch THEN p.mismatch_severity END AS mismatch_severity
       FROM {payload_finding} f LEFT JOIN {profile} p ON p.page_id = f.page_id""",
)
def _(t):
    blank = F.lit("")
    entry = F.struct(
        "issue", "explanation", blank.alias("why_it_matters"), blank.alias("recommended_fix"), F.lit("low").alias("priority"),
        F.lit("low").alias("effort"), F.lit(0.5).alias("confidence"), blank.alias("expected_impact"),
    )
    findings = t.payload_finding.select("page_id", F.array(entry).alias("findings"))
    profiles = t.profile.withColumns(
        {"business_intent": F.col("detected_intent"), "query_intent": F.lit("informational"), "query_intent_confidence": F.col("intent_confidence")}
    )
    out = plan.merge_mismatch_findings(findings, profiles)
    return out.select(
        "page_id", F.array_join(F.transform("findings", lambda f: F.concat(f["issue"], F.lit("="), f["explanation"])), "|").alias("findings"),
        F.get("findings", F.lit(0))["priority"].alias("first_priority"), "intent_mismatch", "mismatch_severity",
    )
