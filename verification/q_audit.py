"""Extraction, link counts, duplicates, the 29 rules, scores and their persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.functions import robots, urls
from siteledger.functions.numeric import severity_rank
from siteledger.operators import rules
from siteledger.plans import audit as plan
from siteledger.sources import html, markup

from .q_impact import q
from .registry import COMMON, common, query, r
from .views import VIEWS

K = "p_partkey"
VIEWS["signal_base"] = f"""
    SELECT {K} AS page_id, CAST(substr(p_brand, 7) AS INT) AS site_id, {K} AS k, p_name, p_size, p_type,
           concat('https://www.site', CAST(substr(p_brand, 7) AS INT), '.test', CASE WHEN {K} % 45 = 0 THEN '/' ELSE concat('/', CASE WHEN {K} % 7 = 0 THEN p_type ELSE lower(p_type) END, CASE WHEN {K} % 11 = 0 THEN '/a/b/c/d/e' ELSE '' END,
                  '/', CASE WHEN {K} % 6 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '-') END, '-', {K}, CASE WHEN {K} % 19 = 0 THEN repeat('-long', 12) ELSE '' END, CASE WHEN {K} % 23 = 0 THEN '%20x' ELSE '' END) END) AS url
    FROM {{part}}"""
VIEWS["signal"] = """
    SELECT page_id, site_id, k, url, url AS final_url, CASE k % 21 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 0 WHEN 3 THEN 500 ELSE 200 END AS status_code, CASE WHEN k % 37 = 0 THEN 'failed' ELSE 'ok' END AS crawl_quality,
           CASE WHEN k % 10 = 0 THEN NULL ELSE repeat(concat(CASE WHEN k % 2 = 0 THEN p_name ELSE upper(p_name) END, ' '), CAST(1 + k % 9 AS INT)) END AS title, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 3 AS INT) END AS title_count,
           CASE WHEN k % 6 = 0 THEN NULL ELSE repeat(concat(p_name, ' '), CAST(1 + k % 25 AS INT)) END AS meta_description, CAST(k % 4 AS INT) AS meta_description_count,
           split_part('index|noindex|nofollow|none|max-image-preview:none|NoIndex, follow|bingbot: noindex|', '|', CAST(1 + k % 8 AS INT)) AS meta_robots,
           split_part('|noindex|googlebot: nofollow|otherbot: none|max-snippet: -1|', '|', CAST(1 + CAST(floor(k / 8) AS INT) % 6 AS INT)) AS x_robots_tag,
           CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN url WHEN 2 THEN concat(url, '/') WHEN 3 THEN 'https://other.test/x' ELSE concat(url, '?utm_source=a') END AS canonical_url,
           CAST(CASE WHEN k % 13 = 0 THEN 2 WHEN k % 5 = 0 THEN 0 ELSE 1 END AS INT) AS canonical_count,
           CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN concat(url, '/') WHEN 2 THEN 'https://a.test/1' WHEN 3 THEN 'https://a.test/1|https://a.test/2' WHEN 4 THEN 'https://a.test/1|https://a.test/2|https://a.test/3'
                WHEN 5 THEN 'https://a.test/1|https://a.test/1/' WHEN 6 THEN concat('https://a.test/1|', url) ELSE '' END AS chain,
           k % 2 = 0 AS has_open_graph, k % 3 <> 0 AS has_viewport, CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN concat(p_name, ' | more') ELSE p_name END AS h1,
           CAST(CASE k % 8 WHEN 0 THEN k % 3 WHEN 1 THEN 2 ELSE 1 END AS INT) AS h1_count, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE k % 5 END AS INT) AS h2_count, CAST(k % 3 AS INT) AS h3_count,
           CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INT) AS h4_count, CAST(0 AS INT) AS h5_count, CAST(CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS INT) AS h6_count,
           CAST(CASE WHEN k % 6 = 5 THEN k % 4 ELSE 0 END AS INT) AS empty_heading_count, repeat(concat(p_name, ' '), CAST(p_size * 2 AS INT)) AS content, CAST(p_size * 3 + k % 60 AS INT) AS word_count, concat(p_name, p_size) AS content_hash,
           CAST(k % 12 AS INT) AS image_count, CAST(least(k % 5, k % 12) AS INT) AS missing_alt_count, CAST(k % 3 AS INT) AS empty_alt_count, CAST(least(k % 7, k % 12) AS INT) AS images_without_dimensions,
           CAST(k % 6 AS INT) AS internal_link_count, CAST(k % 150 AS INT) AS external_link_count, CAST(k % 4 AS INT) AS nofollow_link_count, CAST(k % 5 AS INT) AS broken_link_count, CAST(k % 3 AS INT) AS inbound_internal_links,
           k % 10 = 0 AS structured_data_invalid, k % 3 = 0 AS has_structured_data, CASE WHEN k % 2 = 0 THEN 'Article,Product' ELSE '' END AS types,
           CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'en-US' ELSE 'fr' END AS lang, CASE k % 6 WHEN 1 THEN 'en=u1' WHEN 2 THEN 'de=u2' WHEN 3 THEN '=u3' WHEN 4 THEN 'en=u1;fr=u2' WHEN 5 THEN 'fr=' ELSE '' END AS alternates
    FROM {signal_base}"""


def signals(t):
    split = lambda c, sep: F.filter(F.split(c, sep), lambda x: x != "")
    return t.spread(t.signal).withColumns(
        {
            "redirect_chain": split("chain", r"\|"),
            "structured_data_types": split("types", ","),
            "hreflang": F.transform(
                split("alternates", ";"), lambda a: F.struct(F.substring_index(a, "=", 1).alias("lang"), F.substring_index(a, "=", -1).alias("href"))
            ),
        }
    ).drop("chain", "types", "alternates")


# ── duplicates in SQL ────────────────────────────────────────────────────────
def dup_sql(source: str, key: str, name: str) -> str:
    return f"""SELECT s.*, coalesce(g.c, 0) AS duplicate_{name}_count FROM {source} s LEFT JOIN (SELECT site_id, {key} AS gk, count(*) AS c FROM {source} WHERE {key} IS NOT NULL GROUP BY ALL HAVING count(*) > 1) g
        ON g.site_id = s.site_id AND g.gk = {key.replace('title', 's.title').replace('meta_description', 's.meta_description').replace('word_count', 's.word_count').replace('content_hash', 's.content_hash')}"""


common("dup1", dup_sql("{signal}", "nullif(lower(trim(title)), '')", "title"))
common("dup2", dup_sql("{dup1}", "nullif(lower(trim(meta_description)), '')", "meta"))
common("dup3", dup_sql("{dup2}", "CASE WHEN word_count >= 50 THEN content_hash END", "content"))
NORM = lambda u: f"regexp_replace(regexp_replace({u}, '\\?utm_source=a$', ''), '(.)/$', CASE WHEN regexp_matches({u}, '^https://[^/]*/$') THEN '\\1/' ELSE '\\1' END)"
DIRECTIVES = lambda c: f"list_filter(list_transform(string_split(CASE WHEN regexp_matches({c}, '^(bingbot|otherbot):') THEN '' ELSE regexp_replace({c}, '^googlebot:', '') END, ','), lambda x: lower(trim(x))), lambda x: x <> '' AND NOT regexp_matches(x, '^max-'))"
VALUES_ = lambda c: f"CASE WHEN {c} = 'max-image-preview:none' THEN ['max-image-preview:none'] WHEN {c} = 'max-snippet: -1' THEN ['max-snippet:-1'] ELSE [] END"
common(
    "judged",
    f"""SELECT *, list_sort(list_distinct(list_concat(d_meta, d_head))) AS directives, list_sort(list_concat({VALUES_('meta_robots')}, {VALUES_('x_robots_tag')})) AS dvalues,
          coalesce(list_aggregate(list_filter(string_split(chain, '|'), lambda x: x <> ''), 'count'), 0) AS hops, list_filter(string_split(chain, '|'), lambda x: x <> '') AS chain_list,
          regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS upath, string_split(alternates, ';') AS alts
        FROM (SELECT *, {DIRECTIVES('meta_robots')} AS d_meta, {DIRECTIVES('x_robots_tag')} AS d_head, {NORM('url')} AS own, {NORM('canonical_url')} AS target FROM {{dup3}})""",
)
common(
    "judged2",
    f"""SELECT *, list_transform(chain_list, lambda u: {NORM('u')}) AS nchain, array_to_string(list_concat(directives, dvalues), ', ') AS dlist,
          list_filter([CASE WHEN h1_count > 0 THEN 1 END, CASE WHEN h2_count > 0 THEN 2 END, CASE WHEN h3_count > 0 THEN 3 END, CASE WHEN h4_count > 0 THEN 4 END, CASE WHEN h6_count > 0 THEN 6 END], lambda x: x IS NOT NULL) AS levels,
          list_filter([CASE WHEN length(url) > 100 THEN concat(length(url), ' characters long') END, CASE WHEN contains(url, '%20') THEN 'contains spaces' END, CASE WHEN regexp_matches(upath, '[A-Z]') THEN 'contains uppercase characters' END,
             CASE WHEN length(upath) - length(replace(upath, '/', '')) > 5 THEN concat(length(upath) - length(replace(upath, '/', '')), ' levels deep') END, CASE WHEN contains(upath, '_') THEN 'uses underscores instead of hyphens' END], lambda x: x IS NOT NULL) AS problems,
          CASE WHEN image_count > 0 THEN round_even(100.0 * (image_count - missing_alt_count) / image_count, 0) END AS coverage, status_code = 200 AND crawl_quality <> 'failed' AS evaluable
        FROM {{judged}}""",
)
common("judged3", "SELECT *, list_filter(generate_series(list_min(levels), list_max(levels)), lambda x: NOT list_contains(levels, x)) AS skipped_levels FROM {judged2}")

W, P, X = "warning", "pass", "fail"
cat = lambda *parts: "concat(" + ", ".join(parts) + ")"
_len = lambda c, lo, hi, name, tail: [
    (f"length(trim(coalesce({c}, ''))) = 0", X, 0, "HIGH", q(f"{name[1]} is missing.")),
    (f"length(trim({c})) < {lo}", W, 60, "MEDIUM", cat(q(f"{name[0]} is short ("), f"length(trim({c}))", q(" characters)."))),
    (f"length(trim({c})) > {hi}", W, 60, "MEDIUM", cat(q(f"{name[0]} is long ("), f"length(trim({c}))", q(tail))),
    ("TRUE", P, 100, None, cat(q(f"{name[0]} length is "), f"length(trim({c}))", q(" characters."))),
]
_dup = lambda kind, label, score, sev, unique: [
    (f"duplicate_{kind}_count < 2", P, 100, None, q(unique)), ("TRUE", W, score, sev, cat(q(f"This {label} is used on "), f"duplicate_{kind}_count", q(" pages."))),
]
SQL_RULES = {
    "http_status": [("status_code = 200", P, 100, None, "'Page returned HTTP 200.'"), ("status_code IN (301, 302, 303, 307, 308)", W, 70, "MEDIUM", cat("'Page redirects with HTTP '", "status_code", "'.'")),
                    ("status_code = 0", X, 0, "CRITICAL", "'Page could not be fetched at all.'"), ("TRUE", X, 0, "CRITICAL", cat("'Page returned HTTP '", "status_code", "'.'"))],
    "robots_directive": [("list_contains(directives, 'none')", X, 20, "CRITICAL", q("Page carries 'robots: none', which means noindex plus nofollow.")),
                         ("list_contains(directives, 'noindex')", X, 20, "CRITICAL", cat(q("Page carries a 'noindex' directive in "), "CASE WHEN list_contains(d_head, 'noindex') THEN 'the X-Robots-Tag header' ELSE 'the robots meta tag' END", q(" and will not be indexed."))),
                         ("list_contains(directives, 'nofollow')", W, 60, "HIGH", q("Page carries a 'nofollow' directive, so its links pass no signal.")),
                         ("dlist <> ''", P, 100, None, cat(q("Robots directives present and permissive: "), "dlist", "'.'")), ("TRUE", P, 100, None, "'No restrictive robots directive found.'")],
    "canonical_multiple": [("canonical_count > 1", X, 20, "CRITICAL", cat("canonical_count", q(" canonical tags found — search engines will pick one arbitrarily."))), ("canonical_count = 1", P, 100, None, "'Exactly 1 canonical tag found.'"), ("TRUE", P, 100, None, "'No canonical tag found.'")],
    "canonical_present": [("canonical_count > 1", P, 100, None, "'Canonical presence check skipped (multiple canonical tags detected).'"), ("canonical_url IS NOT NULL", P, 100, None, "'Canonical URL is present.'"), ("TRUE", W, 50, "HIGH", "'Canonical URL is missing.'")],
    "canonical_target": [("canonical_url IS NULL", P, 100, None, "'No canonical to validate.'"), ("own = target", P, 100, None, "'Canonical points at this page.'"),
                         ("TRUE", W, 40, "HIGH", cat(q("Canonical points to a different URL ("), "target", q("), so this page defers to it.")))],
    "redirect_chain": [("hops = 0", P, 100, None, "'URL resolves without redirects.'"), ("hops = 1 AND nchain[1] = own", P, 100, None, q("URL redirects only to its canonical form (trailing slash or scheme).")),
                       ("len(list_distinct(nchain)) < hops OR (hops >= 2 AND list_contains(nchain, own))", X, 0, "CRITICAL", q("Redirect loop detected — the chain returns to a URL it already visited.")),
                       ("hops >= 3", X, 30, "HIGH", cat("'Redirect chain is '", "hops", "' hops long before reaching '", "own", "'.'")), ("hops = 2", W, 60, "MEDIUM", cat("'Redirect chain has 2 hops before reaching '", "own", "'.'")),
                       ("TRUE", W, 85, "LOW", cat("'URL redirects once to '", "own", "'.'"))],
    "title": _len("title", 30, 60, ("Title", "Title tag"), " characters) and will be truncated in results."),
    "meta_description": _len("meta_description", 70, 160, ("Meta description", "Meta description"), " characters) and will be truncated."),
    "open_graph": [("has_open_graph", P, 100, None, "'Open Graph metadata detected.'"), ("TRUE", W, 70, "LOW", "'Open Graph metadata is missing.'")],
    "viewport": [("has_viewport", P, 100, None, "'Viewport meta tag is present.'"), ("TRUE", W, 50, "MEDIUM", q("Viewport meta tag is missing, so the page will not adapt to mobile screens."))],
    "title_multiple": [("title_count IS NULL", P, 100, None, "'Title count not available.'"), ("title_count > 1", X, 30, "HIGH", cat("title_count", q(" <title> tags found — search engines will pick one arbitrarily."))), ("title_count = 1", P, 100, None, "'Exactly one title tag.'"), ("TRUE", P, 100, None, "'No title tag found.'")],
    "meta_description_multiple": [("meta_description_count > 1", W, 50, "MEDIUM", cat("meta_description_count", q(" meta description tags found."))), ("meta_description_count = 1", P, 100, None, "'Exactly one meta description.'"), ("TRUE", P, 100, None, "'No meta description found.'")],
    "h1": [("h1_count = 0", X, 0, "HIGH", "'No H1 heading found.'"), ("h1_count > 1", W, 70, "MEDIUM", cat("h1_count", q(" H1 headings found; keep one and demote the rest to H2."))), ("TRUE", P, 100, None, "'One H1 heading found.'")],
    "heading_structure": [("h2_count = 0 AND h3_count = 0", W, 60, "LOW", "'No H2 or H3 subheadings were found.'"), ("h2_count = 0", W, 80, "LOW", cat("'Page uses '", "h3_count", q(" H3 headings but no H2, so the hierarchy skips a level."))),
                          ("TRUE", P, 100, None, cat("'Found '", "h2_count", "' H2 and '", "h3_count", "' H3 headings.'"))],
    "content_length": [("length(content) < 300", X, 20, "HIGH", cat("'Very little readable content ('", "length(content)", "' characters, '", "word_count", "' words).'")), ("length(content) < 800", W, 60, "MEDIUM", cat("'Readable content is limited ('", "length(content)", "' characters, '", "word_count", "' words).'")),
                       ("TRUE", P, 100, None, cat("'Readable content length is '", "length(content)", "' characters ('", "word_count", "' words).'"))],
    "empty_headings": [("empty_heading_count = 0", P, 100, None, "'No empty headings.'"), ("TRUE", W, 75, "LOW", cat("empty_heading_count", "' heading element(s) contain no text.'"))],
    "heading_depth": [("len(levels) = 0", P, 100, None, "'No headings to assess.'"), ("len(skipped_levels) > 0", W, 80, "LOW", cat("'Heading levels skipped: H'", "array_to_string(skipped_levels, ', H')", "'.'")), ("TRUE", P, 100, None, "'Heading hierarchy is contiguous.'")],
    "image_alt": [("image_count = 0", P, 100, None, "'No images found.'"), ("missing_alt_count = 0", P, 100, None, cat("'All '", "image_count", "' images have alt text or are marked decorative.'", "CASE WHEN empty_alt_count > 0 THEN concat(' (', empty_alt_count, ' marked decorative with alt=\"\".)') ELSE '' END")),
                  ("TRUE", X, "coverage", "CASE WHEN missing_alt_count / image_count > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END", cat("missing_alt_count", "' of '", "image_count", "' images are missing alt text.'", "CASE WHEN empty_alt_count > 0 THEN concat(' (', empty_alt_count, ' intentionally decorative.)') ELSE '' END"))],
    "image_dimensions": [("image_count = 0 OR images_without_dimensions = 0", P, 100, None, "'All images declare width and height.'"), ("images_without_dimensions / image_count < 0.25", P, 90, None, cat("images_without_dimensions", "' of '", "image_count", "' images omit dimensions.'")),
                         ("TRUE", W, 70, "LOW", cat("images_without_dimensions", "' of '", "image_count", "' images do not declare width and height.'"))],
    "internal_links": [("internal_link_count = 0", W, 40, "HIGH", "'No internal links were found on this page.'"), ("internal_link_count < 3", W, 75, "LOW", cat("'Only '", "internal_link_count", "' internal link(s) found.'")), ("TRUE", P, 100, None, cat("internal_link_count", "' internal links found.'"))],
    "broken_links": [("broken_link_count = 0", P, 100, None, "'No broken internal links detected.'"), ("TRUE", X, 30, "CASE WHEN broken_link_count > 2 THEN 'HIGH' ELSE 'MEDIUM' END", cat("broken_link_count", "' internal link(s) point at URLs returning HTTP 4xx/5xx.'"))],
    "orphan_page": [("upath IN ('', '/')", P, 100, None, "'Homepage does not require inbound internal links.'"), ("inbound_internal_links = 0", W, 40, "MEDIUM", "'No other crawled page links to this URL (orphan page).'"), ("inbound_internal_links = 1", P, 85, None, "'One internal link points here.'"),
                    ("TRUE", P, 100, None, cat("inbound_internal_links", "' internal links point here.'"))],
    "external_links": [("external_link_count > 100", W, 60, "LOW", cat("external_link_count", "' outbound external links — unusually high for a single page.'")), ("TRUE", P, 100, None, cat("external_link_count", "' outbound external link(s).'"))],
    "structured_data": [("structured_data_invalid", X, 30, "MEDIUM", q("A JSON-LD block on this page is not valid JSON and will be ignored by search engines.")),
                        ("has_structured_data", P, 100, None, cat("'Structured data detected ('", "CASE WHEN types <> '' THEN replace(types, ',', ', ') ELSE 'present' END", "').'")), ("TRUE", W, 70, "LOW", "'No Schema.org structured data detected.'")],
    "url_structure": [("len(problems) = 0", P, 100, None, "'URL structure is clean.'"), ("TRUE", W, 60, "LOW", cat("'URL structure is non-optimal: '", "array_to_string(problems, ', ')", "'.'"))],
    "hreflang": [("lang IS NULL AND alternates = ''", W, 60, "LOW", "'No lang attribute on <html> and no hreflang alternates declared.'"), ("lang IS NULL", W, 70, "LOW", "'hreflang alternates are declared but <html> has no lang attribute.'"), ("alternates = ''", P, 100, None, cat(q("Language '"), "lang", q("' declared."))),
                 ("alternates IN ('=u3', 'fr=')", W, 60, "LOW", "'1 hreflang alternate(s) are missing a language or href.'"),
                 ("NOT contains(alternates, concat(string_split(lower(lang), '-')[1], '='))", W, 75, "LOW", cat(q("hreflang alternates do not include a self-referencing entry for this page's language ("), "lang", "').'")),
                 ("TRUE", P, 100, None, cat(q("Language '"), "lang", q("' declared with "), "len(alts)", "' hreflang alternate(s).'"))],
    "duplicate_title": _dup("title", "title", 40, "MEDIUM", "Title is unique across the crawled site."),
    "duplicate_meta_description": _dup("meta", "meta description", 50, "LOW", "Meta description is unique across the crawled site."),
    "duplicate_content": [("duplicate_content_count < 2", P, 100, None, "'Page content is unique across the crawled site.'"), ("canonical_url IS NOT NULL AND canonical_url <> url", W, 75, "LOW", cat("'Content is identical to '", "duplicate_content_count - 1", q(" other page(s), but a canonical is declared."))),
                          ("TRUE", W, 30, "HIGH", cat("'Content is byte-identical to '", "duplicate_content_count - 1", q(" other page(s) with no canonical to resolve it.")))],
}
SKIP = cat("'Check skipped: HTTP '", "status_code", "CASE WHEN crawl_quality = 'failed' OR status_code = 0 THEN ' and no document was retrieved' ELSE '' END", "'.'")


def rule_sql(rule_id: str) -> str:
    rows = SQL_RULES[rule_id]
    sev = lambda s: "NULL" if s is None else (s if s.startswith("CASE") else f"'{s}'")
    case = lambda i, f: "CASE " + " ".join(f"WHEN {x[0]} THEN {f(x[i])}" for x in rows) + " END"
    gate = "TRUE" if rule_id in rules.ALWAYS_EVALUATED else "evaluable"
    check = rules.REGISTRY[rule_id].check_type
    return f"""SELECT page_id, site_id, '{rule_id}' AS rule_id, '{check}' AS check_type, CASE WHEN {gate} THEN {case(1, lambda v: f"'{v}'")} ELSE 'skipped' END AS status, CAST(CASE WHEN {gate} THEN {case(2, str)} ELSE 0 END AS DOUBLE) AS score,
        CASE WHEN {gate} THEN {case(3, sev)} END AS severity, CASE WHEN {gate} THEN {case(4, str)} ELSE {SKIP} END AS details FROM {{judged3}}"""


_weights = "CASE check_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in plan.check_weights().items()) + " END"
common("check_row", " UNION ALL ".join(rule_sql(i) for i in SQL_RULES))
common("issue_found", "SELECT * FROM {check_row} WHERE status NOT IN ('pass', 'skipped') AND severity IS NOT NULL")
_rank = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
common(
    "audited",
    f"""SELECT *, CASE WHEN seo_score > 90 THEN 'LOW ISSUES' WHEN seo_score >= 75 THEN 'MEDIUM ISSUES' ELSE 'HIGH ISSUES' END AS seo_category, CASE highest_severity WHEN 'CRITICAL' THEN 'P0' WHEN 'HIGH' THEN 'P1' WHEN 'MEDIUM' THEN 'P2' ELSE 'P3' END AS technical_band FROM (
        SELECT page_id, site_id, {r('sum(CASE WHEN status <> $$skipped$$ THEN score * w ELSE 0 END) / sum(CASE WHEN status <> $$skipped$$ THEN w ELSE 0 END)'.replace('$$', "'"), 1)} AS seo_score,
          count(*) FILTER (WHERE iss AND severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE iss AND severity = 'HIGH') AS high_count, count(*) FILTER (WHERE iss AND severity = 'MEDIUM') AS medium_count, count(*) FILTER (WHERE iss AND severity = 'LOW') AS low_count,
          count(*) FILTER (WHERE iss) AS issue_count, split_part('NONE,LOW,MEDIUM,HIGH,CRITICAL', ',', CAST(1 + max(CASE WHEN iss THEN {_rank} ELSE 0 END) AS INTEGER)) AS highest_severity
        FROM (SELECT *, CAST({_weights} AS DOUBLE) AS w, status NOT IN ('pass', 'skipped') AND severity IS NOT NULL AS iss FROM {{check_row}}) GROUP BY page_id, site_id)""",
)


def checked(t):
    return plan.run_checks(plan.annotate(signals(t)))


def audited(t):
    return plan.score_checks(checked(t))


for _number, _id in enumerate(SQL_RULES, start=1):

    def _make(number: int, rule_id: str) -> None:
        @query(f"rul{number:02d}_{rule_id}", f"SELECT page_id, status, score, severity, details FROM ({rule_sql(rule_id)})")
        def _(t):
            pages = plan.annotate(signals(t)) if rule_id.startswith("duplicate") else signals(t)
            status = F.coalesce("status_code", F.lit(200))
            usable = html.is_usable()
            skipped = rules.outcome("skipped", rules.text("Check skipped: HTTP {s}{w}.", s=status, w=F.when(usable, "").otherwise(" and no document was retrieved")))
            x = rules.evaluated(rules.REGISTRY[rule_id], (status == 200) & usable, skipped)
            return pages.withColumns({"crawl_error": F.lit("none"), "content_size": F.length("content")}).select("page_id", x.alias("x")).select("page_id", "x.o.status", "x.o.score", "x.o.severity", "x.o.details")

    _make(_number, _id)

_CATEGORIES = "(VALUES " + ", ".join(f"('{x.id}', '{x.check_type}', '{x.category}', {x.weight}::DOUBLE, {q(x.title)})" for x in rules.REGISTRY.values()) + ") AS c(rule_id, check_type, category, weight, title)"


@query(
    "rul30_rule_catalogue",
    f"SELECT c.rule_id, c.check_type, c.category, c.weight, c.title, count(i.page_id) AS failing_pages FROM {_CATEGORIES} LEFT JOIN {{issue_found}} i ON i.rule_id = c.rule_id GROUP BY ALL",
)
def _(t):
    found = plan.issue_rows(audited(t)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("failing_pages"))
    return rules.catalogue(t.spark).join(found, "rule_id", "left").fillna(0, ["failing_pages"]).select(
        "rule_id", "check_type", "category", "weight", "title", "failing_pages"
    )


AUDIT = "page_id, site_id, seo_score, critical_count, high_count, medium_count, low_count, issue_count, highest_severity, seo_category, technical_band"


@query("pipe01_site_audit", f"SELECT {AUDIT} FROM {{audited}}")
def _(t):
    return audited(t).select(*AUDIT.split(", "))


@query("agg14_weighted_score", "SELECT page_id, seo_score FROM {audited}")
def _(t):
    return audited(t).select("page_id", "seo_score")


@query("agg08_severity_counts", "SELECT page_id, critical_count, high_count, medium_count, low_count, highest_severity FROM {audited}")
def _(t):
    return audited(t).select("page_id", "critical_count", "high_count", "medium_count", "low_count", "highest_severity")


@query(
    "agg13_audit_totals",
    f"""SELECT site_id, count(*) AS page_count, {r('avg(seo_score)', 1)} AS average_seo_score, CAST(sum(issue_count) AS BIGINT) AS total_issues, CAST(sum(critical_count) AS BIGINT) AS critical_issues,
          count(*) FILTER (WHERE seo_category = 'HIGH ISSUES') AS high_issue_pages, count(*) FILTER (WHERE highest_severity = 'CRITICAL') AS critical_pages FROM {{audited}} GROUP BY site_id""",
)
def _(t):
    out = plan.audit_totals(audited(t))
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).cast("long")
    return out.select(
        "site_id", "page_count", "average_seo_score", "total_issues", "critical_issues",
        at("by_category", "HIGH ISSUES").alias("high_issue_pages"), at("by_severity", "CRITICAL").alias("critical_pages"),
    )


_KEYS = {"title": "nullif(lower(trim(title)), '')", "meta": "nullif(lower(trim(meta_description)), '')", "content": "CASE WHEN word_count >= 50 THEN content_hash END"}

@query(
    "jn09_duplicate_groups",
    f"""SELECT page_id, duplicate_title_count, duplicate_meta_count, duplicate_content_count, CASE WHEN duplicate_title_count > 0 THEN title_examples END AS title_examples, CASE WHEN duplicate_meta_count > 0 THEN meta_examples END AS meta_examples,
               CASE WHEN duplicate_content_count > 0 THEN content_examples END AS content_examples FROM (
          SELECT page_id, {', '.join(f'{k}_n AS duplicate_{k}_count' for k in _KEYS)}, {', '.join(f"array_to_string(list_filter({k}_all, lambda u: u <> url)[1:5], ' ') AS {k}_examples" for k in _KEYS)} FROM (
            SELECT s.page_id, s.url, {', '.join(f'coalesce({k}_g.n, 0) AS {k}_n, {k}_g.urls AS {k}_all' for k in _KEYS)} FROM {{signal}} s
            {' '.join(f"LEFT JOIN (SELECT site_id, {v} AS gk, count(*) AS n, list(url ORDER BY url) AS urls FROM {{signal}} WHERE {v} IS NOT NULL GROUP BY ALL HAVING count(*) > 1) {k}_g ON {k}_g.site_id = s.site_id AND {k}_g.gk = {v.replace('title', 's.title').replace('meta_description', 's.meta_description').replace('word_count', 's.word_count').replace('content_hash', 's.content_hash')}" for k, v in _KEYS.items())}))""",
)
def _(t):
    kinds = ("title", "meta", "content")
    return plan.annotate(signals(t)).select(
        "page_id", *[F.col(f"duplicate_{k}_count").cast("long").alias(f"duplicate_{k}_count") for k in kinds],
        *[F.array_join(f"duplicate_{k}_examples", " ").alias(f"{k}_examples") for k in kinds],
    )


OWN_RULES: dict[str, rules.Rule] = {}  # user-defined checks: the decorator alone makes them part of audit, catalogue and weights
FAILING_RULES: dict[str, rules.Rule] = {}


@rules.rule("many_sections", "headings", 0.0, "Many sections", "Split the page.", into=OWN_RULES)
def many_sections():
    """Long pages with many sections."""
    c = rules.n("h2_count")
    return rules.decide((c > 3, rules.warn(rules.text("{c} sections", c=c), 90.0, "LOW")), otherwise=rules.ok("fine"))


@rules.row_rule("alt_ratio", "images", 0.0, "Share of images without text", "Describe the images.", ("image_count", "missing_alt_count"), into=OWN_RULES)
def alt_ratio(page):
    """Divides without looking: pages without images raise."""
    share = page["missing_alt_count"] / page["image_count"]
    return {"status": "warning", "score": 100 - 50 * share, "severity": "LOW", "details": f"{share:.2f}", "evidence": {"images": page["image_count"]}} if share > 0.5 else None


@rules.rule("words_per_section", "headings", 0.0, "Words per section", "Split the page.", into=FAILING_RULES)
def words_per_section():
    """Divides without looking: pages without H2 fail."""
    return rules.warn(rules.text("{w} words", w=F.col("word_count")), 100 / F.col("h2_count"), "LOW")


@rules.rule("numeric_title", "metadata", 0.0, "Number in title", "Use words.", into=FAILING_RULES)
def numeric_title():
    """Casts text that is never a number."""
    return rules.fail("a number", "HIGH", F.col("title").cast("int") + 1)


@rules.rule("first_type", "structured_data", 0.0, "First type", "Name a type.", into=FAILING_RULES)
def first_type():
    """Looks up an element that only some pages have."""
    kind = F.element_at("structured_data_types", 1)
    return rules.outcome(F.when(kind.isNotNull(), "warning"), kind, 50.0, "LOW", advice=F.concat(F.lit("Check "), kind))


@rules.rule("unknown_column", "metadata", 0.0, "Unknown column", "None.", into=FAILING_RULES)
def unknown_column():
    """Reads a column that no page table has."""
    return rules.warn("never", F.col("no_such_column"), "LOW")


@rules.rule("broken", "metadata", 0.0, "Broken", "None.", into=FAILING_RULES)
def broken():
    """Raises while it is built."""
    raise RuntimeError("boom")


def _own_checks(t, registry, *fields):
    pages = rules.apply_rules(signals(t), F.lit(True), F.col("status_code"), F.lit(True), registry)
    return pages.select("page_id", F.explode("checks").alias("c")).select("page_id", *[f"c.{f}" for f in fields])


@query("udf01_registered_rule", """
    SELECT page_id, 'many_sections' AS rule_id, CASE WHEN h2_count > 3 THEN 'warning' ELSE 'pass' END AS status, CASE WHEN h2_count > 3 THEN 90.0 ELSE 100.0 END::DOUBLE AS score, CASE WHEN h2_count > 3 THEN concat(h2_count, ' sections') ELSE 'fine' END AS details, NULL AS images FROM {signal}
    UNION ALL SELECT page_id, 'alt_ratio', CASE WHEN s > 0.5 THEN 'warning' ELSE 'pass' END, CASE WHEN s > 0.5 THEN 100 - 50 * s ELSE 100 END, CASE WHEN s > 0.5 THEN printf('%.2f', s) ELSE 'No problem detected.' END, CASE WHEN s > 0.5 THEN image_count::VARCHAR END
    FROM (SELECT *, CASE WHEN image_count > 0 THEN missing_alt_count::DOUBLE / image_count END AS s FROM {signal})""")
def _(t):
    return _own_checks(t, OWN_RULES, "rule_id", "status", "score", "details", "evidence").withColumn("images", F.try_element_at("evidence", F.lit("images"))).drop("evidence")


@query("udf01_failing_rules", """
    SELECT page_id, rule_id, CASE WHEN bad THEN 'pass' ELSE 'warning' END AS status, CASE WHEN bad THEN 100 ELSE score END::DOUBLE AS score, CASE WHEN bad THEN NULL ELSE 'LOW' END AS severity, CASE WHEN bad THEN 'No problem detected.' ELSE details END AS details, CASE WHEN bad THEN hint ELSE advice END AS recommendation FROM (
      SELECT page_id, 'words_per_section' AS rule_id, h2_count = 0 AS bad, CASE WHEN h2_count > 0 THEN 100.0 / h2_count END AS score, concat(word_count, ' words') AS details, 'Split the page.' AS hint, 'Split the page.' AS advice FROM {signal}
      UNION ALL SELECT page_id, 'first_type', types = '', 50.0, split_part(types, ',', 1), 'Name a type.', concat('Check ', split_part(types, ',', 1)) FROM {signal}
      UNION ALL SELECT page_id, 'numeric_title', TRUE, NULL, NULL, 'Use words.', NULL FROM {signal}
      UNION ALL SELECT page_id, x, TRUE, NULL, NULL, 'None.', NULL FROM {signal}, (VALUES ('unknown_column'), ('broken')) AS v(x))""")
def _(t):
    return _own_checks(t, FAILING_RULES, "rule_id", "status", "score", "severity", "details", "recommendation")


@query("rul01_advice_and_error", f"""
    SELECT page_id, CASE WHEN status_code IN (301, 302, 303, 307, 308) THEN 'Link directly to the destination URL so users and crawlers skip the hop.' WHEN status_code = 0 THEN 'Check DNS, TLS and server availability for this URL.'
             ELSE 'Fix the server or application response so the URL returns HTTP 200.' END AS recommendation,
           CASE WHEN status_code <> 200 THEN status_code::VARCHAR END AS status_code, CASE WHEN status_code = 0 AND k % 2 = 0 THEN concat('timeout after ', k % 9, ' s') END AS error FROM {{signal}}""")
def _(t):
    failed = F.when((F.col("status_code") == 0) & (F.col("k") % 2 == 0), F.concat(F.lit("timeout after "), (F.col("k") % 9).cast("string"), F.lit(" s")))
    rows = plan.run_checks(plan.annotate(signals(t).withColumn("crawl_error", failed))).select("page_id", F.filter("checks", lambda c: c["rule_id"] == "http_status")[0].alias("c"))
    at = lambda key: F.try_element_at("c.evidence", F.lit(key))
    return rows.select("page_id", "c.recommendation", at("status_code").alias("status_code"), at("error").alias("error"))


# ── extraction of the supplied pages ─────────────────────────────────────────
def documents(t):
    return t.spread(t.pages).withColumn("base_domain", urls.domain_of("url"))


_strip = lambda e: f"regexp_replace(regexp_replace(regexp_replace({e}, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')"
_words = lambda e: f"len(list_filter(string_split({_strip(e)}, ' '), lambda w: w <> ''))"
# Character references as HTML reads them: the old names also without their semicolon; the ampersand last, so that nothing is decoded twice.
_REFERENCES = {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&#39;": "''", "&apos;": "''", "&copy;?": "©", "&middot;?": "·", "&amp;?": "&"}


def _dec(e):
    for reference, character in _REFERENCES.items():
        e = f"regexp_replace({e}, '{reference}', '{character}', 'g')"
    return f"trim({e})"
# A thin article inside a page with much more text outside it is only a fragment: the whole body counts.
_ARTICLE = "regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's')"
_REST = "regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<nav>.*?</nav>|<footer>.*?(</footer>|$)', ' ', 'gs')"
_plain = lambda e: _dec(_strip(e))
common(
    "page_signal",
    f"""SELECT page_id, url, {_dec("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_dec("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
          len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS internal_link_count, CASE WHEN length({_plain(_ARTICLE)}) < 300 AND length({_plain(_REST)}) >= 3 * greatest(length({_plain(_ARTICLE)}), 1) THEN {_words(_REST)} ELSE {_words(_ARTICLE)} END AS word_count, {_words("regexp_extract(html, '<body>(.*)$', 1, 's')")} AS raw_word_count FROM pages""",
)
SIGNALS = ("page_id", "title", "h1", "lang", "internal_link_count", "word_count", "raw_word_count")


@query("src01_page_signals", f"SELECT {', '.join(SIGNALS)} FROM {{page_signal}}")
def _(t):
    return html.extract_pages(documents(t)).select(*SIGNALS)


# The supplied pages in the shape that the SQL of the rules reads: what their markup lacks is absent.
_THIN = f"length({_plain(_ARTICLE)}) < 300 AND length({_plain(_REST)}) >= 3 * greatest(length({_plain(_ARTICLE)}), 1)"
common(
    "html_signal",
    f"""SELECT s.page_id, lower(regexp_extract(s.url, '^https?://([^/?#:]*)', 1)) AS site_id, s.page_id AS k, s.url, s.url AS final_url, 200 AS status_code, 'ok' AS crawl_quality, s.title, 1 AS title_count, CAST(NULL AS VARCHAR) AS meta_description, 0 AS meta_description_count,
              '' AS meta_robots, '' AS x_robots_tag, CAST(NULL AS VARCHAR) AS canonical_url, 0 AS canonical_count, '' AS chain, FALSE AS has_open_graph, FALSE AS has_viewport, s.h1, greatest(1, len(list_filter(string_split(s.h1, ' | '), lambda x: trim(x) <> ''))) AS h1_count, 0 AS h2_count, 0 AS h3_count, 0 AS h4_count, 0 AS h5_count, 0 AS h6_count, 0 AS empty_heading_count,
              CASE WHEN {_THIN} THEN {_plain(_REST)} ELSE {_plain(_ARTICLE)} END AS content, s.word_count, CASE WHEN {_THIN} THEN {_plain(_REST)} ELSE {_plain(_ARTICLE)} END AS content_hash, 0 AS image_count, 0 AS missing_alt_count, 0 AS empty_alt_count, 0 AS images_without_dimensions, s.internal_link_count, 0 AS external_link_count,
              0 AS nofollow_link_count, 0 AS broken_link_count, 0 AS inbound_internal_links, FALSE AS structured_data_invalid, FALSE AS has_structured_data, '' AS types, s.lang, '' AS alternates
       FROM {{page_signal}} s JOIN pages p USING (page_id)""",
)
_STEPS = ("dup1", "dup2", "dup3", "judged", "judged2", "judged3", "check_row", "audited")
for _name in _STEPS:
    _text = COMMON[_name].replace("{signal}", "{html_signal}")
    for _step in _STEPS:
        _text = _text.replace("{" + _step + "}", "{html_" + _step + "}")
    common(f"html_{_name}", _text)


@query("pipe01_site_audit_of_html", "SELECT page_id, site_id, seo_score, issue_count, highest_severity, seo_category FROM {html_audited}")
def _(t):
    pages = html.extract_pages(documents(t)).withColumns({"site_id": F.col("base_domain"), "final_url": F.col("url")})
    return plan.audit_pages(pages).select("page_id", "site_id", "seo_score", "issue_count", "highest_severity", "seo_category")


@query("flt07_render_needed", f"SELECT page_id, length({_plain(_ARTICLE)}) < 3000 AS thin FROM pages")
def _(t):
    return html.extract_pages(documents(t)).select("page_id", html.needs_rendering(minimum=3000).alias("thin"))


@query("flt07_render_needed_by_default", f"SELECT page_id, length({_plain(_ARTICLE)}) < 400 AS thin FROM pages")
def _(t):
    return html.extract_pages(documents(t)).select("page_id", html.needs_rendering().alias("thin"))


@query("flt08_document_predicates", """SELECT page_id, status_code BETWEEN 200 AND 299 AND crawl_quality = 'ok' AS has_document, crawl_quality <> 'failed' AND status_code <> 0 AS usable FROM {signal}""")
def _(t):
    return t.signal.select("page_id", html.has_document().alias("has_document"), html.is_usable().alias("usable"))


# JSON-LD documents built from the catalogue of parts.
VIEWS["ld_page"] = """
    SELECT p_partkey AS page_id, concat('https://www.shop.test/', p_partkey) AS url,
           concat('<html><head><title>', p_name, '</title><script type="application/ld+json">{"@type":"Product","offers":{"@type":["Offer","', p_type, '"]}', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '}' END,
                  '</script></head><body><div itemscope itemtype="https://schema.org/', p_brand, '/">x</div><p typeof="schema:Person">y</p></body></html>') AS html
    FROM {part}"""


@query(
    "scl66_structured_data_types",
    """SELECT p_partkey AS page_id, concat(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('Product,Offer,', p_type, ',') END, p_brand, ',Person') AS types, p_partkey % 7 = 0 AS invalid FROM part""",
)
def _(t):
    out = html.extract_pages(t.spread(t.ld_page).withColumn("base_domain", F.lit("shop.test")))
    return out.select("page_id", F.array_join("structured_data_types", ",").alias("types"), F.col("structured_data_invalid").alias("invalid"))


# ── link graph over consecutive order lines ──────────────────────────────────
VIEWS["edge"] = """
    SELECT a.url, concat(b.url, CASE WHEN e.o % 3 = 0 THEN '/?utm_source=x' ELSE '' END) AS link FROM (
      SELECT l_orderkey AS o, l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS d FROM {lineitem}) e
    JOIN {page} a ON a.page_id = e.s JOIN {page} b ON b.page_id = e.d"""
common(
    "link_count",
    """SELECT p.page_id, coalesce(b.n, 0) AS broken_link_count, coalesce(i.n, 0) AS inbound_internal_links FROM {page} p
       LEFT JOIN (SELECT e.url, count(*) AS n FROM {edge} e JOIN {page} d ON d.url = replace(e.link, '/?utm_source=x', '') WHERE d.status_code >= 400 GROUP BY e.url) b ON b.url = p.url
       LEFT JOIN (SELECT replace(link, '/?utm_source=x', '') AS target, count(DISTINCT url) AS n FROM {edge} GROUP BY 1) i ON i.target = p.url""",
)


@query("jn08_link_counts", "SELECT * FROM {link_count}")
def _(t):
    edges = t.spread(t.edge).select("url", urls.normalize_url("link").alias("target"))
    pages = t.page.withColumn("final_url", F.col("url"))
    return plan.link_counts(edges, pages).join(t.page.select("url", "page_id"), "url").select("page_id", "broken_link_count", "inbound_internal_links")


# ── persistence ──────────────────────────────────────────────────────────────
VIEWS.update(
    {
        # Several observations per page: URL variants of one page, some failed. Every third page is found under a new URL, and every
        # fourth stored one lies under an old URL, so that some are missing and some are new.
        "observation": """
            SELECT l_orderkey * 10 + l_linenumber AS observation_id, site_id, concat(url, CASE WHEN l_partkey % 3 = 0 THEN '/moved' ELSE '' END, CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '?gclid=1' END) AS url, CAST(NULL AS STRING) AS final_url,
                   CASE WHEN l_suppkey % 5 = 0 THEN 500 WHEN l_suppkey % 7 = 0 THEN 0 ELSE 200 END AS status_code, CASE WHEN l_suppkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS crawl_quality,
                   CASE WHEN l_suppkey % 7 = 0 THEN 'timeout' END AS crawl_error, concat('new title ', l_orderkey) AS title, CAST(l_quantity AS INT) AS word_count, l_shipdate AS fetched_at, l_partkey AS k
            FROM {lineitem} JOIN {page} ON page_id = l_partkey""",
        "stored_page": """
            SELECT site_id, page_id, concat(url, CASE WHEN page_id % 4 = 0 THEN '/old' ELSE '' END) AS url, path, status_code, title, word_count, is_active, CAST('1990-01-01' AS TIMESTAMP) AS first_seen_at, CAST('1990-06-01' AS TIMESTAMP) AS last_seen_at, CAST('1990-06-01' AS TIMESTAMP) AS content_captured_at
            FROM {page}""",
    }
)
common(
    "collapsed",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, regexp_replace(url, '(/|\\?gclid=1)$', '') AS nurl, row_number() OVER (PARTITION BY site_id, k ORDER BY fetched_at DESC, observation_id DESC) AS rn FROM {observation}) WHERE rn = 1""",
)


def collapsed(t):
    return plan.collapse_observations(t.observation)


def stored(t):
    return t.stored_page.withColumn("url_hash", urls.url_hash("url"))


@query("set05_observation_collapse", "SELECT site_id, nurl AS url, observation_id, status_code FROM {collapsed}")
def _(t):
    return collapsed(t).select("site_id", "url", "observation_id", "status_code")


@query(
    "snk02_page_snapshot_upsert",
    """SELECT coalesce(o.nurl, p.url) AS url, coalesce(o.site_id, p.site_id) AS site_id, coalesce(o.status_code, p.status_code) AS status_code, CASE WHEN o.k IS NOT NULL AND o.status_code BETWEEN 200 AND 299 AND o.crawl_quality = 'ok' THEN o.title ELSE p.title END AS title,
          CASE WHEN o.k IS NOT NULL AND o.status_code BETWEEN 200 AND 299 AND o.crawl_quality = 'ok' THEN o.word_count ELSE p.word_count END AS word_count, CAST(coalesce(p.first_seen_at, o.fetched_at) AS DATE) AS first_seen,
          CAST(CASE WHEN o.k IS NOT NULL AND o.status_code BETWEEN 200 AND 299 AND o.crawl_quality = 'ok' THEN o.fetched_at ELSE p.content_captured_at END AS DATE) AS captured, CASE WHEN o.k IS NOT NULL THEN TRUE ELSE p.is_active END AS is_active
       FROM {stored_page} p FULL JOIN {collapsed} o ON o.nurl = p.url""",
)
def _(t):
    out = plan.merge_snapshot(stored(t), collapsed(t), ["title", "word_count"])
    return out.select(
        "url", "site_id", "status_code", "title", "word_count", F.to_date("first_seen_at").alias("first_seen"),
        F.to_date("content_captured_at").alias("captured"), "is_active",
    )


VIEWS["crawl_run"] = "SELECT n_nationkey + 1 AS site_id, CASE WHEN n_nationkey % 3 = 0 THEN 'incremental' ELSE 'full' END AS mode FROM {nation}"


@query(
    "jn05_missing_pages",
    """SELECT p.page_id FROM {stored_page} p WHERE p.is_active AND p.site_id IN (SELECT site_id FROM {crawl_run} WHERE mode = 'full') AND p.site_id <> 8
         AND p.site_id IN (SELECT site_id FROM {collapsed} WHERE status_code BETWEEN 200 AND 399 AND crawl_error IS NULL) AND NOT EXISTS (SELECT 1 FROM {collapsed} o WHERE o.nurl = p.url)""",
)
def _(t):
    # Site 8 failed completely: its pages must stay active.
    failed = F.col("site_id") == 8
    observed = collapsed(t).withColumn("status_code", F.when(failed, 0).otherwise(F.col("status_code")))
    return plan.missing_pages(stored(t), observed, t.crawl_run).select("page_id")


@query(
    "snk03_issue_history",
    """SELECT issue_id, page_id, check_type, is_resolved OR page_id IN (SELECT page_id FROM {page} WHERE page_id % 3 = 0) AS is_resolved FROM {issue}
       UNION ALL SELECT -issue_id, page_id, check_type, FALSE FROM {issue} WHERE page_id % 3 = 0 AND severity = 'HIGH'""",
)
def _(t):
    new = t.issue.filter("page_id % 3 = 0 and severity = 'HIGH'").select((-F.col("issue_id")).alias("issue_id"), "page_id", "check_type")
    out = plan.merge_issues(t.issue.select("issue_id", "page_id", "check_type", "is_resolved"), t.page.filter("page_id % 3 = 0"), new)
    return out.select("issue_id", "page_id", "check_type", "is_resolved")


VIEWS["variant"] = """
    SELECT page_id * 10 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS page_id, site_id, url, is_active FROM {page}
    UNION ALL SELECT page_id * 10 + 2, site_id, concat(url, '?utm_source=a'), is_active FROM {page} WHERE page_id % 2 = 0
    UNION ALL SELECT page_id * 10 + 3, site_id, concat(url, '?sort=asc&id=7'), TRUE FROM {page} WHERE page_id % 5 = 0
    UNION ALL SELECT page_id * 10 + 4, site_id, concat(url, '?id=7'), TRUE FROM {page} WHERE page_id % 10 = 0
    UNION ALL SELECT page_id * 10 + 5, site_id, concat(url, '?id=7&view=list'), TRUE FROM {page} WHERE page_id % 20 = 0"""


@query(
    "win09_parameter_variants",
    """SELECT page_id, rn = 1 AND (url = norm OR NOT EXISTS (SELECT 1 FROM {variant} o WHERE o.site_id = x.site_id AND o.url = x.norm)) AS keep FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, norm ORDER BY CASE WHEN contains(url, '?') THEN 1 ELSE 0 END, length(url), page_id) AS rn FROM (
           SELECT *, regexp_replace(regexp_replace(replace(url, '?utm_source=a', ''), 'sort=asc&', ''), '&view=list', '') AS norm FROM {variant} WHERE is_active)) x""",
)
def _(t):
    # Stored rows carry the hash of the URL as it was first stored.
    pages = t.variant.withColumn("url_hash", F.sha2("url", 256))
    return plan.parameter_variants(pages).select("page_id", "keep")


@query(
    "agg05_site_summary",
    f"""SELECT p.site_id, count(*) AS total_pages, {r('avg(seo_score)', 1)} AS average_seo_score, count(*) FILTER (WHERE priority_band IN ('P0', 'P1')) AS high_priority_page_count, coalesce(max(c.n), 0) AS critical_issue_count
        FROM {{page}} p LEFT JOIN (SELECT g.site_id, count(*) AS n FROM {{issue}} i JOIN {{page}} g ON g.page_id = i.page_id WHERE g.is_active AND NOT i.is_resolved AND i.severity = 'CRITICAL' GROUP BY 1) c ON c.site_id = p.site_id WHERE p.is_active GROUP BY p.site_id""",
)
def _(t):
    return plan.site_summary(t.page, t.issue)


@query("jn03_open_issues", "SELECT i.issue_id, i.page_id, p.site_id FROM {issue} i JOIN {page} p ON p.page_id = i.page_id WHERE p.is_active AND NOT i.is_resolved")
def _(t):
    return plan.open_issues(t.issue, t.page).select("issue_id", "page_id", "site_id")


# ── URL and directive functions ──────────────────────────────────────────────
_u = "regexp_replace(url, '#.*$', '')"
_kept = f"list_sort(list_filter(string_split(regexp_extract({_u}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|utm_source)=') AND NOT regexp_matches(x, '^page=[01]$')))"
_np = f"regexp_replace(regexp_extract({_u}, '^([^?]*)', 1), '(.)/$', '\\1')"
common("normal_url", f"SELECT page_id, concat({_np}, CASE WHEN len({_kept}) > 0 THEN concat('?', array_to_string({_kept}, '&')) ELSE '' END) AS norm FROM pages")


@query("scl01_normalize_url", "SELECT page_id, norm FROM {normal_url}")
def _(t):
    return t.pages.select("page_id", urls.normalize_url("url").alias("norm"))


@query("scl02_hashes", "SELECT page_id, sha256(norm) AS url_hash, NULLIF(sha256(trim(lower(regexp_replace(title, '\\s+', ' ', 'g')))), sha256('')) AS title_hash FROM {normal_url} JOIN {page_signal} USING (page_id)")
def _(t):
    titles = html.extract_pages(documents(t)).select("page_id", "url", "title")
    return titles.select("page_id", urls.url_hash("url").alias("url_hash"), urls.content_hash("title").alias("title_hash"))


@query(
    "scl03_url_parts",
    """SELECT page_id, regexp_replace(norm, '^https?://[^/]*', '') AS path, lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) AS domain, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '^www\\.', '') AS registrable FROM {normal_url} JOIN pages USING (page_id)""",
)
def _(t):
    return t.pages.select(
        "page_id", urls.url_path("url").alias("path"), urls.domain_of("url").alias("domain"), urls.registrable_domain("url").alias("registrable")
    )


@query("scl04_provider_path", "SELECT event_id, CASE WHEN raw_url = '' THEN '/' ELSE CASE WHEN starts_with(raw_url, '/') THEN '' ELSE '/' END || rtrim(lower(regexp_replace(raw_url, '[?#].*$', '')), '/') END AS norm FROM {provider_row} WHERE NOT starts_with(raw_url, 'http')")
def _(t):
    return t.provider_row.filter(~F.col("raw_url").startswith("http")).select("event_id", urls.provider_path("raw_url").alias("norm"))


VIEWS["odd_url"] = """
    SELECT l_orderkey * 10 + l_linenumber AS row_id, concat('https://www.x.test/', split_part('blog,en,api,a,shop,login', ',', CAST(1 + l_partkey % 6 AS INT)), '/', split_part('blog,en,b,a,www.site.com,c', ',', CAST(1 + l_suppkey % 6 AS INT)), '/', l_partkey % 5,
           split_part('|.pdf|.html|.JPG|/|.com', '|', CAST(1 + l_orderkey % 6 AS INT)), CASE WHEN l_linenumber = 1 THEN '?page=1&b=2&a=%20x' ELSE '' END) AS url FROM {lineitem}"""
_seg = "list_filter(string_split(lower(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)), '/'), lambda s: s <> '')"
_free = f"list_filter({_seg}, lambda s: NOT list_contains({'[' + ', '.join(q(s) for s in urls.REPEATABLE_SEGMENTS) + ']'}, s))"
LOOP = f"(len(list_filter({_seg}, lambda s: regexp_matches(s, {q(urls.HOST_LIKE_SEGMENT)}))) > 0 OR len({_free}) > len(list_distinct({_free})))"
PAGE = f"NOT {LOOP} AND NOT list_has_any({_seg}, {'[' + ', '.join(q(s) for s in urls.BLOCKED_SEGMENTS) + ']'}) AND lower(regexp_extract(url, '\\.([^./?]*)(\\?.*)?$', 1)) NOT IN ({', '.join(q(s) for s in urls.ASSET_EXTENSIONS)})"


@query("scl05_recursive_path_loop", f"SELECT url, {LOOP} AS looping FROM {{odd_url}}")
def _(t):
    return t.odd_url.select("url", urls.has_recursive_path_loop("url").alias("looping"))


@query("scl06_probably_page", f"SELECT url, {PAGE} AS page FROM {{odd_url}}")
def _(t):
    return t.odd_url.select("url", urls.is_probably_page("url").alias("page"))


@query("scl07_glob_match", "SELECT page_id, regexp_matches(path, '^/(economy|promo)/.*$') OR regexp_matches(url, '^.*ring-[^?]*1$') AS hit FROM {page}")
def _(t):
    return t.page.select("page_id", urls.matches_any("url", ["/economy/*", "/promo/*", "*ring-*1"]).alias("hit"))


VIEWS["href"] = """
    SELECT page_id, url, split_part('/a/b|c/d?x=1&utm_source=k|?q=2|//cdn.test/z|www.other.test/p|mailto:a@b.c|#top|https://h.test/q/../r/./s|', '|', CAST(1 + page_id % 9 AS INT)) AS href FROM {page}"""


@query(
    "scl08_link_resolution",
    """SELECT page_id, CASE page_id % 9 WHEN 0 THEN concat(root, '/a/b') WHEN 1 THEN concat(regexp_extract(url, '^(.*/)', 1), 'c/d?x=1') WHEN 2 THEN concat(url, '?q=2') WHEN 3 THEN 'https://cdn.test/z' WHEN 4 THEN 'https://www.other.test/p'
         WHEN 7 THEN 'https://h.test/q/../r/./s' END AS target FROM (SELECT *, regexp_extract(url, '^(https://[^/]*)', 1) AS root FROM {href})""",
)
def _(t):
    return t.href.select("page_id", urls.resolve_link("url", "href").alias("target"))


@query(
    "scl09_robots_directives",
    "SELECT page_id, array_to_string(list_sort(d_meta), ',') AS meta, list_contains(d_meta, 'noindex') OR list_contains(d_meta, 'none') AS noindex, list_contains(d_meta, 'nofollow') OR list_contains(d_meta, 'none') AS nofollow FROM {judged}",
)
def _(t):
    d = robots.parse("meta_robots")["directives"]
    return t.signal.select(
        "page_id", F.array_join(F.array_sort(d), ",").alias("meta"), robots.noindex(d).alias("noindex"), robots.nofollow(d).alias("nofollow")
    )


@query("set02_directive_union", "SELECT page_id, array_to_string(directives, ',') AS directives, array_to_string(dvalues, ',') AS dvalues FROM {judged}")
def _(t):
    d = robots.resolve("meta_robots", "x_robots_tag")
    return t.signal.select("page_id", F.array_join(d["directives"], ",").alias("directives"), F.array_join(d["values"], ",").alias("dvalues"))


# ── agreement of two measurements ────────────────────────────────────────────
# The supplied pages with more markup, made from the page id, so that SQL knows what each metric must be.
VIEWS["marked_page"] = """
    SELECT page_id, url, concat(split_part(html, '</head>', 1),
             CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<meta name="description" content="', CASE WHEN page_id % 3 = 1 THEN concat('About page ', page_id, ' &amp; more') ELSE '' END, '">') END, CASE WHEN page_id % 11 = 0 THEN '<META NAME=description CONTENT="second">' ELSE '' END,
             CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('<link rel="canonical" href="', url, '">') WHEN 2 THEN '<link href="/other" rel="shortlink canonical"/>' ELSE '<link rel=canonical href=https://other.test/x><link rel="canonical" href="/second">' END,
             CASE WHEN page_id % 5 = 0 THEN '<meta name="robots" content="noindex, follow">' ELSE '' END, repeat(concat('<link rel="alternate" hreflang="fr" href="/fr/', page_id, '">'), CAST(page_id % 3 AS INT)),
             CASE WHEN page_id % 2 = 0 THEN '<script type="application/ld+json">{"@type":"Article","x":"<h2>no</h2><img src=q>"}</script>' ELSE '' END, '</head>', substr(html, length(split_part(html, '</head>', 1)) + 8, instr(html, '</article>') - length(split_part(html, '</head>', 1)) - 8),
             repeat('<h2>Part <b>two</b></h2>', CAST(page_id % 4 AS INT)), repeat('<h3 class="x">Detail</h3>', CAST(page_id % 3 AS INT)), '<!-- <h2>gone</h2> <img src="/c.png"> -->',
             repeat('<img src="/a.png" alt="a picture" width=9 height=9>', CAST(page_id % 2 AS INT)), repeat('<img src="/b.png">', CAST(page_id % 3 AS INT)), repeat('<img src="/d.png" alt="">', CAST(page_id % 5 AS INT)),
             CASE WHEN page_id % 6 = 0 THEN '<img src="/pixel.gif" width="1" height="1" alt="">' ELSE '' END,
             concat('<a href="https://partner.test/', page_id, '" rel="nofollow noopener">p</a><a href="https://partner.test/', page_id, '">again</a>'), repeat('<a href="mailto:x@y.test">m</a><a href="#top">t</a>', CAST(page_id % 2 AS INT)),
             CASE WHEN page_id % 7 = 0 THEN '<div itemscope itemtype="https://schema.org/Thing">i</div>' ELSE '' END, substr(html, instr(html, '</article>'))) AS html
    FROM {pages}"""
common(
    "marked_signal",
    """SELECT s.page_id, s.title, s.h1, s.lang, s.internal_link_count, CASE WHEN p.page_id % 3 = 1 THEN concat('About page ', p.page_id, ' & more') WHEN p.page_id % 11 = 0 THEN 'second' END AS meta_description, CASE WHEN p.page_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN p.page_id % 11 = 0 THEN 1 ELSE 0 END AS meta_description_count,
              [0, 1, 1, 2][CAST(p.page_id % 4 + 1 AS INT)] AS canonical_count, CASE p.page_id % 4 WHEN 1 THEN p.url WHEN 2 THEN '/other' WHEN 3 THEN 'https://other.test/x' END AS canonical_raw, CASE WHEN p.page_id % 5 = 0 THEN 'noindex, follow' END AS meta_robots, p.page_id % 3 AS hreflang_count,
              1 AS h1_count, p.page_id % 4 AS h2_count, p.page_id % 3 AS h3_count, p.page_id % 2 + p.page_id % 3 + p.page_id % 5 AS image_count, p.page_id % 3 AS missing_alt_count, p.page_id % 5 AS empty_alt_count, 1 AS external_link_count, 1 AS nofollow_link_count, p.page_id % 2 = 0 AS json_ld, p.page_id % 7 = 0 AS microdata,
              CASE WHEN p.page_id % 2 = 0 THEN concat('Article', CASE WHEN p.page_id % 7 = 0 THEN ',Thing' ELSE '' END) WHEN p.page_id % 7 = 0 THEN 'Thing' ELSE '' END AS types, CASE p.page_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'self' WHEN 2 THEN 'relative' ELSE 'multiple' END AS canonical_status,
              p.page_id % 2 + p.page_id % 3 + p.page_id % 5 - p.page_id % 2 AS images_without_dimensions
       FROM {page_signal} s JOIN pages p USING (page_id)""",
)
MARKED = (
    "title", "h1", "lang", "internal_link_count", "meta_description", "meta_description_count", "canonical_count", "canonical_raw", "meta_robots", "h1_count", "h2_count", "h3_count", "image_count", "missing_alt_count", "empty_alt_count",
    "external_link_count", "nofollow_link_count", "images_without_dimensions",
)


def marked(t):
    return html.extract_pages(t.spread(t.marked_page).withColumn("base_domain", urls.domain_of("url")))


@query("src01_marked_signals", f"SELECT page_id, {', '.join(MARKED)}, hreflang_count, json_ld, microdata, types, 1 AS title_count, FALSE AS structured_data_invalid FROM {{marked_signal}}")
def _(t):
    formats = lambda kind: F.array_contains("structured_data_formats", kind)
    return marked(t).select(
        "page_id", *MARKED, F.size("hreflang").alias("hreflang_count"), formats("json-ld").alias("json_ld"), formats("microdata").alias("microdata"), F.array_join("structured_data_types", ",").alias("types"), "title_count", "structured_data_invalid",
    )


_SECOND = {
    "status_code": "200", "title": "title", "title_count": "1", "meta_description_present": "page_id % 3 = 1 OR (page_id % 3 = 0 AND page_id % 11 = 0)", "meta_description_count": "meta_description_count", "canonical_count": "canonical_count", "canonical_href": "canonical_raw", "h1_count": "1", "h1_text": "h1",
    "h2_count": "h2_count", "h3_count": "h3_count", "img_count": "image_count + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END", "img_missing_alt": "missing_alt_count", "external_links": "2", "nofollow_links": "1", "meta_robots": "meta_robots", "lang": "lang", "hreflang_count": "hreflang_count", "json_ld": "json_ld", "microdata": "microdata",
    "img_empty_alt": "empty_alt_count + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END",
}


@query("pipe16_markup_signals", f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _SECOND.items())} FROM {{marked_signal}}")
def _(t):
    return markup.markup_signals(t.spread(t.marked_page).withColumn("base_domain", urls.domain_of("url"))).select("page_id", *_SECOND)


# The extraction takes the first description that says something, the second measurement the first one.
_AGREE = {m: "TRUE" for m in _SECOND} | {"meta_description_present": "NOT (page_id % 3 = 2 AND page_id % 11 = 0)", "img_count": "page_id % 6 <> 0", "img_empty_alt": "page_id % 6 <> 0", "external_links": "FALSE"}


@query(
    "pipe16_extraction_agreement",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS pages, count(*) FILTER (WHERE {same}) AS agreed, {'0' if m in ('img_count', 'external_links') else f'count(*) FILTER (WHERE NOT ({same}))'} AS differing, {f'count(*) FILTER (WHERE NOT ({same}))' if m in ('img_count', 'external_links') else '0'} AS expected_differences FROM pages" for m, same in _AGREE.items()),
)
def _(t):
    mine = markup.extracted_signals(marked(t))
    theirs = markup.markup_signals(t.spread(t.marked_page).withColumn("base_domain", urls.domain_of("url")))
    known = t.pages.select("page_id", F.explode(F.array(*[F.lit(m) for m in markup.EXPECTED])).alias("metric"))
    report = plan.agreement(mine, theirs, "page_id", list(markup.METRICS), known)
    return report.filter(F.col("metric").isin(list(_AGREE))).select("metric", "pages", "agreed", "differing", "expected_differences")
