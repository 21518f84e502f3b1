"""Deliveries, changed files, routes, diffs, predictions and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.functions import changes as cx
from siteledger.functions.numeric import rnd
from siteledger.plans import changes as plan
from siteledger.plans import experiments as xp
from siteledger.sources import webhooks

from .q_facts import ga4, gsc
from .q_impact import profiles, q
from .registry import common, query, r
from .views import VIEWS

# Worked by hand: path | ignored | touches every page | route by the generic order | route under flat routes.
FILES = [
    ("app/blog/page.tsx", 0, 0, "/blog", None),
    ("pages/about.tsx", 0, 0, "/about", None),
    ("src/routes/shop/+page.svelte", 0, 0, "/shop", "/+page"),
    ("content/docs/guide.md", 0, 0, "/docs/guide", None),
    ("_posts/2024-01-02-hello-world.md", 0, 0, "/hello-world", None),
    ("public/pricing.html", 0, 0, "/pricing", None),
    ("app/(marketing)/offers/page.tsx", 0, 0, "/offers", None),
    ("app/products/[slug]/page.tsx", 0, 0, "/products", None),
    ("app/_private/x/page.tsx", 0, 0, None, None),
    ("README.md", 1, 0, None, None),
    ("docs/architecture.md", 1, 0, None, None),
    ("components/Button.tsx", 0, 1, None, None),
    ("styles/site.css", 0, 1, None, None),
    ("package.json", 0, 1, None, None),
    ("app/contact/page.tsx", 0, 0, "/contact", None),
    ("lib/util.ts", 0, 0, None, None),
    ("routes/blog.post.tsx", 0, 0, "/blog.post", "/blog/post"),
    ("index.html", 0, 0, "/", None),
    ("app/tests/page.test.tsx", 1, 0, "/tests/page.test", None),
    ("migrations/001.py", 1, 0, None, None),
    ("app/$id/page.tsx", 0, 0, "/", None),
    ("pages/index.jsx", 0, 0, "/", None),
    ("vendor/yarn.lock", 1, 0, None, None),
    ("app/layout.tsx", 0, 1, "/layout", None),
]
PATHS = "|".join(f[0] for f in FILES)
_v = lambda x: "NULL" if x is None else (q(x) if isinstance(x, str) else str(x))
common("file_fact", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_v(x) for x in f) + ")" for f in FILES) + ") AS f(path, ignored, shared, route, flat)")
pick = lambda e: f"split_part('{PATHS}', '|', CAST(1 + ({e}) % {len(FILES)} AS INT))"

VIEWS.update(
    {
        "push_file": f"""
            SELECT o_orderkey AS k, o_custkey % 27 AS s, CASE WHEN o_orderkey % 11 = 0 THEN 'ping' WHEN o_orderkey % 13 = 0 THEN 'issues' ELSE 'push' END AS event_type, o_orderkey % 17 = 0 AS deleted,
                   CASE WHEN o_orderkey % 9 = 0 THEN 'refs/tags/v1' WHEN o_orderkey % 5 = 0 THEN 'refs/heads/dev' ELSE 'refs/heads/main' END AS ref,
                   {pick('o_custkey')} AS f1, {pick('o_orderkey * 5 + 1')} AS f2, {pick('o_orderkey * 7 + o_custkey')} AS f3 FROM {{orders}}""",
        "push": """
            SELECT k AS event_id, concat('d-', k) AS delivery_id, event_type, concat('{"ref":"', ref, '","before":"b', k, '","after":"a', k, '","deleted":', CASE WHEN deleted THEN 'true' ELSE 'false' END, ',"repository":{"full_name":"ORG/Repo', s, '"},"sender":{"login":"dev"},',
                   '"commits":[', CASE WHEN k % 50 = 0 THEN '' ELSE concat('{"message":"change ', k, chr(92), 'nmore","added":["', f1, '"],"modified":["', f2, '"],"removed":[]},{"message":"second","modified":["', f1, '","', f3, '"]}') END,
                   ']', CASE WHEN k % 50 = 0 THEN '' ELSE concat(',"head_commit":{"added":["', f2, '"]}') END, '}') AS payload FROM {push_file}""",
        "repo_site": """
            SELECT site_id, concat('org/repo', site_id) AS github_repo, CASE WHEN site_id % 4 = 1 THEN 'dev' WHEN site_id % 4 = 2 THEN CAST(NULL AS STRING) ELSE 'main' END AS github_branch, concat('https://', domain, '/') AS base_url, is_active,
                   CASE WHEN site_id % 5 = 0 THEN 'Remix' END AS framework, site_id % 3 = 0 AS has_map FROM {site}""",
    }
)
common(
    "push_parsed",
    """SELECT k, event_type, deleted, CASE WHEN ref LIKE 'refs/heads/%' THEN replace(ref, 'refs/heads/', '') END AS branch, CASE WHEN ref LIKE 'refs/heads/%' THEN x.site_id ELSE a.site_id END AS site_id, s,
         CASE WHEN k % 50 = 0 THEN [] ELSE list_filter([f1, CASE WHEN f2 <> f1 THEN f2 END, CASE WHEN f3 <> f1 AND f3 <> f2 THEN f3 END], lambda f: f IS NOT NULL) END AS files
       FROM {push_file} p LEFT JOIN {repo_site} x ON lower(x.github_repo) = concat('org/repo', p.s) AND coalesce(x.github_branch, 'main') = replace(p.ref, 'refs/heads/', '')
       LEFT JOIN {repo_site} a ON lower(a.github_repo) = concat('org/repo', p.s)""",
)
common(
    "push_mapped",
    """SELECT p.*, r.is_active, r.base_url, coalesce(m.kept, 0) AS kept, coalesce(m.unmapped, 0) AS unmapped, m.shared_path, coalesce(m.paths, []) AS paths FROM {push_parsed} p LEFT JOIN {repo_site} r ON r.site_id = p.site_id
       LEFT JOIN (SELECT k, count(*) FILTER (WHERE ignored = 0) AS kept, count(*) FILTER (WHERE ignored = 0 AND target IS NULL) AS unmapped, min_by(path, i) FILTER (WHERE ignored = 0 AND shared = 1 AND mapped IS NULL) AS shared_path,
                    list(DISTINCT target) FILTER (WHERE ignored = 0 AND target IS NOT NULL) AS paths FROM (
                  SELECT e.k, e.i, f.path, f.ignored, f.shared, e.mapped, coalesce(e.mapped, CASE WHEN e.framework = 'Remix' THEN f.flat ELSE f.route END) AS target FROM (
                    SELECT p.k, unnest(p.files) AS path, unnest(range(len(p.files))) AS i, r.framework, CASE WHEN r.has_map AND unnest(p.files) = 'lib/util.ts' THEN '/tools' WHEN r.has_map AND unnest(p.files) = 'components/Button.tsx' THEN '/button' END AS mapped
                    FROM {push_parsed} p LEFT JOIN {repo_site} r ON r.site_id = p.site_id) e JOIN {file_fact} f ON f.path = e.path) GROUP BY k) m ON m.k = p.k""",
)
_L = [
    ("event_type = 'ping'", "ignored", "'Webhook ping received.'"),
    ("event_type <> 'push'", "ignored", "concat('''', event_type, ''' events are not acted on.')"),
    ("site_id IS NULL", "unmatched_repository", "concat('No active website is mapped to ORG/Repo', s, ' on branch ', coalesce(branch, 'None'), '. Connect the repository under the website''s integrations to enable re-audits.')"),
    ("deleted", "ignored", "'Branch deletion, nothing to re-audit.'"),
    ("NOT is_active", "ignored", "'The website is not active.'"),
    ("len(files) = 0", "full_crawl", "'The push carried no file list (GitHub omits it for very large pushes), so the whole site is re-audited.'"),
    ("kept = 0", "ignored", "'No changed file can affect rendered output.'"),
    ("shared_path IS NOT NULL", "full_crawl", "concat('''', shared_path, ''' is shared across pages (layout, template, component or config), so its effect cannot be limited to specific URLs.')"),
    ("len(paths) = 0", "full_crawl", "concat('None of the ', kept, ' changed files could be mapped to a URL, so the whole site is re-audited to stay correct.')"),
    ("len(paths) > 2", "full_crawl", "concat(len(paths), ' pages changed, which exceeds the 2-page incremental limit; a full crawl is cheaper.')"),
    ("TRUE", "incremental_crawl", "concat(len(paths), ' page(s) resolved from ', kept, ' changed file(s).', CASE WHEN unmapped > 0 THEN concat(' ', unmapped, ' file(s) could not be mapped.') ELSE '' END)"),
]
_act = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, a, _ in _L) + " END"
_why = "CASE " + " ".join(f"WHEN {c} THEN {w}" for c, _, w in _L) + " END"


def sites(t):
    mapping = F.create_map(F.lit("/lib/util.ts"), F.lit("/tools"), F.lit("components/Button.tsx"), F.lit("/button"))
    return t.repo_site.withColumn("path_map", F.when(F.col("has_map"), mapping)).drop("has_map")


def log(t):
    return webhooks.delivery_log(t.spread(t.push))


def scoped(t):
    return plan.push_scope(plan.match_sites(log(t), sites(t)), sites(t), max_targets=2)


@query("src08_changed_files", "SELECT k AS event_id, array_to_string(files, ' ') AS files FROM {push_parsed}")
def _(t):
    return webhooks.parse(t.spread(t.push)).select("event_id", F.array_join(webhooks.changed_files(), " ").alias("files"))


@query(
    "src12_delivery_log",
    """SELECT k AS event_id, branch, concat('ORG/Repo', s) AS repository, 'dev' AS pusher, CASE WHEN k % 50 = 0 THEN 0 ELSE 2 END AS commit_count, CASE WHEN k % 50 = 0 THEN '' ELSE concat('change ', k, '|second') END AS messages,
         len(files) AS changed_file_count, concat('a', k) AS after_sha FROM {push_parsed}""",
)
def _(t):
    return log(t).select(
        "event_id", "branch", "repository", "pusher", "commit_count", F.array_join("commit_messages", "|").alias("messages"),
        F.col("changed_file_count").cast("long").alias("changed_file_count"), F.try_element_at("raw_payload", F.lit("after")).alias("after_sha"),
    )


@query("jn16_push_to_site", "SELECT k AS event_id, site_id FROM {push_parsed}")
def _(t):
    return plan.match_sites(log(t), sites(t)).select("event_id", "site_id")


@query("chg03_push_scope", f"SELECT k AS event_id, {_act} AS action, {_why} AS reason FROM {{push_mapped}}")
def _(t):
    return scoped(t).select("event_id", "action", "reason")


_free = [x for x in _L if x[0] != "len(paths) > 2"]
_case = lambda i: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[i]}" if i == 2 else f"WHEN {x[0]} THEN '{x[i]}'" for x in _free) + " END"


@query("chg03_push_scope_no_limit", f"SELECT k AS event_id, {_case(1)} AS action, {_case(2)} AS reason FROM {{push_mapped}}")
def _(t):
    return plan.push_scope(plan.match_sites(log(t), sites(t)), sites(t)).select("event_id", "action", "reason")


@query(
    "chg03_affected_urls",
    f"SELECT k AS event_id, unnest(list_transform(paths, lambda p: concat(rtrim(base_url, '/'), p))) AS url FROM (SELECT *, {_act} AS action FROM {{push_mapped}}) WHERE action = 'incremental_crawl'",
)
def _(t):
    return scoped(t).select("event_id", F.explode("affected_urls").alias("url"))


VIEWS["file_use"] = f"SELECT l_orderkey * 10 + l_linenumber AS use_id, {pick('l_suppkey')} AS path FROM {{lineitem}}"


@query("chg01_file_to_route", "SELECT u.use_id, u.path, f.route, f.flat FROM {file_use} u JOIN {file_fact} f ON f.path = u.path")
def _(t):
    return t.spread(t.file_use).select("use_id", "path", cx.route_of(F.col("path")).alias("route"), cx.route_of(F.col("path"), F.lit("remix")).alias("flat"))


@query("chg02_file_flags", "SELECT u.use_id, f.ignored = 1 AS ignorable, f.shared = 1 AS shared FROM {file_use} u JOIN {file_fact} f ON f.path = u.path")
def _(t):
    return t.spread(t.file_use).select("use_id", cx.is_ignorable(F.col("path")).alias("ignorable"), cx.has_global_impact(F.col("path")).alias("shared"))


@query("udf02_route_resolver", "SELECT use_id, concat('/x/', path) AS route FROM {file_use}")
def _(t):
    cx.register_resolver("mirror", lambda path: F.concat(F.lit("/x/"), path))
    return t.spread(t.file_use).select("use_id", cx.route_of(F.col("path"), F.lit("mirror")).alias("route"))


@query(
    "udf03_explicit_path_map",
    "SELECT k AS event_id, path, mapped FROM (SELECT p.k, unnest(p.files) AS path, CASE WHEN r.has_map AND unnest(p.files) = 'lib/util.ts' THEN '/tools' WHEN r.has_map AND unnest(p.files) = 'components/Button.tsx' THEN '/button' END AS mapped FROM {push_parsed} p JOIN {repo_site} r ON r.site_id = p.site_id) WHERE mapped IS NOT NULL",
)
def _(t):
    rows = plan.match_sites(log(t), sites(t)).join(sites(t).select("site_id", "framework", "path_map"), "site_id")
    files = rows.select("event_id", F.explode(plan.mapped_files(F.col("files"), F.col("framework"), F.col("path_map"))).alias("f"))
    return files.filter("f.explicit is not null").select("event_id", "f.path", F.col("f.explicit").alias("mapped"))


# ── diffs: ten patches with results worked by hand ───────────────────────────
NL, Q = "', chr(10), '", "', chr(39), '"
PATCHES = [
    f"-<title>Old Title</title>{NL}+<title>New Title</title>",
    f"-<h1>Keep  me</h1>{NL} context",
    '+<link rel="canonical" href="https://x.test/a">',
    '+<meta name="robots" content="noindex, follow">',
    f'-<meta name="robots" content="noindex">{NL}+<meta name="robots" content="index">',
    '-<script type="application/ld+json">{"@type": "Product"}</script>',
    f'-<a href="/a">x</a>{NL}-<a href="/b">x</a>{NL}-<a href={Q}/c{Q}>x</a>{NL}+<a href="//cdn">x</a>',
    f"--- a/file{NL}+++ b/file{NL}+plain text",
    f'-{{"@type":"Article"}}{NL}+{{"@type":"NewsArticle"}}',
    f"+title: {Q}Fresh start{Q}",
]
EXPECTED = [
    (0, "title", "neutral", 0.38, 'Title changed from "Old Title" to "New Title".'),
    (1, "h1", "negative", 0.80, 'H1 removed: was "Keep me".'),
    (2, "canonical", "positive", 0.55, 'Canonical added: "https://x.test/a".'),
    (3, "robots", "negative", 1.0, "A noindex directive was added — this page would be removed from search results."),
    (4, "robots", "positive", 1.0, "A noindex directive was removed — this page becomes indexable again."),
    (5, "schema", "negative", 0.50, "Structured data removed (Product)."),
    (6, "internal_links", "negative", 0.27, "Internal links decreased by 3 (3 -> 0)."),
    (8, "schema", "neutral", 0.15, "Structured data types changed: removed ['Article'], added ['NewsArticle']."),
    (9, "title", "positive", 0.95, 'Title added: "Fresh start".'),
]
common("patch_fact", "SELECT * FROM (VALUES " + ", ".join(f"({p}, {q(k)}, {q(d)}, {w}::DOUBLE, {q(x)})" for p, k, d, w, x in EXPECTED) + ") AS f(pid, change_type, direction, weight, description)")
_patch = "CASE l_partkey % 10 " + " ".join(f"WHEN {i} THEN concat('', '{p}')" for i, p in enumerate(PATCHES)) + " END"
VIEWS["pr_file"] = f"""
    SELECT l_orderkey AS pr_id, CAST(1 + l_orderkey % 25 AS INT) AS site_id, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS file_id, {pick('l_suppkey * 5 + l_linenumber')} AS filename, {_patch} AS patch, l_partkey % 10 AS pid,
           CAST(l_quantity AS INT) AS additions, CAST(l_suppkey % 40 AS INT) AS deletions FROM {{lineitem}}"""
common(
    "diff",
    f"""SELECT pr_id, site_id, file_id, filename, change_type, direction, weight, description FROM {{pr_file}} JOIN {{file_fact}} f ON f.path = filename JOIN {{patch_fact}} USING (pid) WHERE f.ignored = 0
        UNION ALL SELECT pr_id, site_id, file_id, filename, 'content_length', 'negative', 0.90 * deletions / (additions + deletions), concat('Content reduced substantially: ', deletions, ' lines removed, ', additions, ' added (net ', CASE WHEN additions >= deletions THEN '+' ELSE '' END, additions - deletions, ').')
          FROM {{pr_file}} JOIN {{file_fact}} f ON f.path = filename WHERE f.ignored = 0 AND additions + deletions >= 10 AND deletions >= 15 AND deletions / (additions + deletions) >= 0.6""",
)


def raw_changes(t):
    return plan.pr_changes(t.spread(t.pr_file.drop("pid")), sites(t))


@query(
    "src09_patch_lines",
    "SELECT file_id, pid, array_to_string(list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: substr(x, 2)), chr(10)) AS added, array_to_string(list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: substr(x, 2)), chr(10)) AS removed FROM {pr_file}",
)
def _(t):
    p = F.col("patch")
    return t.pr_file.select("file_id", "pid", cx.patch_lines(p, "+").alias("added"), cx.patch_lines(p, "-").alias("removed"))


def _diff_query(key: str, kinds: tuple[str, ...]) -> None:
    listed = ", ".join(q(k) for k in kinds)

    @query(key, f"SELECT pr_id, file_id, change_type, direction, {r('weight', 6)} AS weight, description FROM {{diff}} WHERE change_type IN ({listed})")
    def _(t):
        rows = raw_changes(t).filter(F.col("change_type").isin(*kinds))
        return rows.select("pr_id", "file_id", "change_type", "direction", rnd("weight", 6).alias("weight"), "description")


_diff_query("chg04_tag_changes", ("title", "h1", "canonical"))
_diff_query("chg05_robots_change", ("robots",))
_diff_query("chg06_schema_change", ("schema",))
_diff_query("chg07_content_reduction", ("content_length",))
_diff_query("chg08_internal_link_delta", ("internal_links",))


@query("set03_schema_types_difference", "SELECT file_id, CASE pid WHEN 5 THEN 'Product' WHEN 8 THEN 'Article' ELSE '' END AS removed, CASE pid WHEN 8 THEN 'NewsArticle' ELSE '' END AS added FROM {pr_file}")
def _(t):
    types = lambda sign: F.array_sort(F.array_distinct(F.regexp_extract_all(cx.patch_lines(F.col("patch"), sign), F.lit(cx.SCHEMA_TYPE), 1)))
    return t.pr_file.select(
        "file_id", F.array_join(F.array_except(types("-"), types("+")), ",").alias("removed"), F.array_join(F.array_except(types("+"), types("-")), ",").alias("added")
    )


# Target keywords of the pages a file renders: by site, "old title", "new" or none.
common("refined", """SELECT pr_id, file_id, change_type, CASE WHEN hit = 'lost' THEN 'negative' WHEN hit = 'gained' THEN 'positive' ELSE direction END AS direction, weight * CASE hit WHEN 'lost' THEN 1.6 WHEN 'gained' THEN 1.3 ELSE 1 END AS weight,
      concat(description, CASE hit WHEN 'lost' THEN ' The target keyword present in the previous title is no longer present — this weakens topical relevance for the keyword this page was ranking for.'
        WHEN 'gained' THEN ' The new title now includes the page''s target keyword, which the previous version did not.' ELSE '' END) AS description FROM (
      SELECT d.*, CASE WHEN direction = 'neutral' AND change_type = 'title' AND f.route IN ('/about', '/blog') AND d.site_id % 5 <> 0 THEN CASE d.site_id % 3 WHEN 0 THEN 'lost' WHEN 1 THEN 'gained' END END AS hit FROM {diff} d JOIN {file_fact} f ON f.path = d.filename)""")


def refined(t):
    word = F.when(F.col("site_id") % 3 == 0, "old title").when(F.col("site_id") % 3 == 1, "new")
    pages = t.repo_site.withColumn("route", F.explode(F.array(F.lit("/about"), F.lit("/blog")))).filter("site_id % 3 <> 2")
    keywords = pages.select("site_id", F.concat(F.regexp_replace("base_url", "/$", ""), "route").alias("url"), F.array(word).alias("keywords"))
    return plan.pr_changes(t.spread(t.pr_file.drop("pid")), sites(t), keywords)


@query("chg09_keyword_refinement", f"SELECT pr_id, file_id, change_type, direction, {r('weight', 6)} AS weight, description FROM {{refined}}")
def _(t):
    return refined(t).select("pr_id", "file_id", "change_type", "direction", rnd("weight", 6).alias("weight"), "description")


common(
    "prediction",
    f"""SELECT *, CASE WHEN risk_level IN ('critical', 'high') THEN 'DO NOT DEPLOY WITHOUT REVISION' WHEN risk_level = 'medium' THEN 'Review before merging — some findings may reduce SEO performance.' WHEN negatives = 0 THEN 'No blocking SEO concerns detected.' ELSE 'Safe to merge; minor findings noted below.' END AS recommendation FROM (
        SELECT pr_id, change_count, negatives, CASE WHEN p > 0 AND n = 0 THEN 'positive' WHEN n > 0 AND p = 0 THEN 'negative' WHEN p > 0 AND n > 0 THEN 'mixed' ELSE 'neutral' END AS expected_impact, {r('least(0.95, p / t * 0.9)', 2)} AS positive_confidence, {r('least(0.95, n / t * 0.9)', 2)} AS negative_confidence,
          CASE WHEN noindex OR {r('n', 6)} >= 2.2 THEN 'critical' WHEN {r('n', 6)} >= 1.2 THEN 'high' WHEN {r('n', 6)} >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM (
        SELECT pr_id, count(*) AS change_count, count(*) FILTER (WHERE direction = 'negative') AS negatives, CAST(coalesce(sum(weight) FILTER (WHERE direction = 'positive'), 0) AS DOUBLE) AS p, CAST(coalesce(sum(weight) FILTER (WHERE direction = 'negative'), 0) AS DOUBLE) AS n, CAST(sum(weight) AS DOUBLE) AS t,
          bool_or(direction = 'negative' AND change_type = 'robots' AND contains(description, 'was added')) AS noindex FROM {{refined}} GROUP BY pr_id))""",
)


def predictions(t):
    return plan.predict(refined(t))


@query("agg16_deployment_prediction", "SELECT pr_id, change_count, expected_impact, positive_confidence, negative_confidence, risk_level, recommendation FROM {prediction}")
def _(t):
    return predictions(t).select("pr_id", "change_count", "expected_impact", "positive_confidence", "negative_confidence", "risk_level", "recommendation")


@query(
    "agg16_finding_rows",
    """SELECT pr_id, direction, file_id, n AS findings, CAST(1 + coalesce(sum(n) OVER (PARTITION BY pr_id, direction ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_rank, texts
       FROM (SELECT pr_id, direction, file_id, count(*) AS n, count(DISTINCT description) AS texts FROM {refined} GROUP BY ALL)""",
)
def _(t):
    """Ranks go on from file to file; inside a file they follow the position."""
    rows = plan.finding_rows(refined(t)).groupBy("pr_id", "direction", "file_id")
    return rows.agg(F.count(F.lit(1)).alias("findings"), F.min("finding_rank").alias("first_rank"), F.count_distinct("description").alias("texts"))


_remedy = "CASE change_type " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in cx.SUGGESTIONS.items()) + " END"


@query("agg16_suggested_changes", f"SELECT pr_id, count(DISTINCT change_type) AS suggestions, bool_or(change_type = 'h1') AS keep_h1 FROM {{refined}} WHERE direction = 'negative' GROUP BY pr_id")
def _(t):
    rows = predictions(t).filter(F.size("suggested_changes") > 0)
    return rows.select("pr_id", F.size("suggested_changes").cast("long").alias("suggestions"), F.array_contains("suggested_changes", cx.SUGGESTIONS["h1"]).alias("keep_h1"))


@query("chg10_gate_state", "SELECT pr_id, CASE WHEN pr_id % 3 = 0 THEN NULL WHEN pr_id % 3 = 1 AND risk_level IN ('high', 'critical') THEN 'failure' ELSE 'success' END AS state FROM {prediction}")
def _(t):
    mode = F.when(F.col("pr_id") % 3 == 0, "off").when(F.col("pr_id") % 3 == 1, "block").otherwise("warn")
    return predictions(t).select("pr_id", cx.gate_state(mode, "risk_level").alias("state"))


@query("jn12_keywords_by_url", "SELECT p.url, concat(lower(f.primary_keyword), '|', lower(f.secondary_keyword)) AS keywords FROM {profile} f JOIN {page} p ON p.page_id = f.page_id")
def _(t):
    return plan.keywords_by_url(t.page, profiles(t)).select("url", F.array_join("keywords", "|").alias("keywords"))


# ── analyses and experiments ─────────────────────────────────────────────────
VIEWS.update(
    {
        "analysis": """
            SELECT l_orderkey * 10 + l_linenumber AS analysis_id, l_orderkey AS pr_id, split_part('positive,negative,mixed,neutral', ',', CAST(1 + l_suppkey % 4 AS INT)) AS predicted_impact,
                   split_part('low,medium,high', ',', CAST(1 + l_suppkey % 3 AS INT)) AS predicted_risk_level FROM {lineitem}""",
        "pull_request": "SELECT o_orderkey AS pr_id, CAST(1 + o_orderkey % 25 AS INT) AS site_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged_at FROM {orders}",
        "pr_change": """
            SELECT l_orderkey * 1000 + l_suppkey AS change_id, l_orderkey * 10 + l_linenumber AS analysis_id, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_partkey END AS page_id, concat('/p/', l_partkey) AS affected_url, CAST(l_quantity AS DOUBLE) / 10 AS weight FROM {lineitem}""",
        "tracked": "SELECT DISTINCT CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey * 10 + l_linenumber ELSE -l_orderkey END AS analysis_id FROM {lineitem}",
    }
)
common("newest_analysis", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY analysis_id DESC, predicted_impact DESC, predicted_risk_level DESC) AS rn FROM {analysis}) WHERE rn = 1")


@query("jn17_latest_analysis", "SELECT p.pr_id, a.analysis_id FROM {pull_request} p LEFT JOIN {newest_analysis} a ON a.pr_id = p.pr_id")
def _(t):
    return plan.latest_analysis(t.pull_request, t.analysis).select("pr_id", "analysis_id")


common(
    "experiment",
    """SELECT p.pr_id, p.site_id, a.analysis_id, c.page_id, p.merged_at AS deployed_at FROM {pull_request} p JOIN {newest_analysis} a ON a.pr_id = p.pr_id
       JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY weight DESC, change_id) AS rn FROM {pr_change} WHERE page_id IS NOT NULL) WHERE rn = 1) c ON c.analysis_id = a.analysis_id
       WHERE p.merged_at IS NOT NULL AND a.analysis_id NOT IN (SELECT analysis_id FROM {tracked})""",
)


@query("jn18_experiment_creation", "SELECT pr_id, analysis_id, page_id, d AS checkpoint_day, CAST(deployed_at AS DATE) + d AS due_date FROM {experiment}, (VALUES (7), (14), (28)) AS v(d)")
def _(t):
    made = xp.new_experiments(t.pull_request, t.analysis, t.pr_change, t.tracked)
    return xp.with_checkpoints(made).select("pr_id", "analysis_id", "page_id", "checkpoint_day", "due_date")


# Checkpoints to measure: deploy days spread over the analytics window.
VIEWS["checkpoint"] = """
    SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS experiment_id, CAST(1 + l_orderkey % 25 AS INT) AS site_id, CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE (l_partkey % 150) * 13 END AS page_id,
           split_part('positive,negative,mixed,neutral', ',', CAST(1 + l_suppkey % 4 AS INT)) AS predicted_impact, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE split_part('low,medium,high', ',', CAST(1 + l_suppkey % 3 AS INT)) END AS predicted_risk_level,
           CAST('2001-06-25' AS DATE) + CAST(l_orderkey % 25 AS INT) AS deployed_at, CAST(CASE l_linenumber % 3 WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 28 END AS INT) AS checkpoint_day,
           CAST('2001-06-25' AS DATE) + CAST(l_orderkey % 25 AS INT) + CAST(CASE l_linenumber % 3 WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 28 END AS INT) AS due_date,
           CASE WHEN l_returnflag = 'A' THEN 'completed' ELSE 'monitoring' END AS status, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN CAST('2001-07-01' AS DATE) END AS measured_at
    FROM {lineitem}"""


def window_sql(label: str, low: str, high: str) -> str:
    return f"""coalesce(s_{label}.clicks, 0) AS {label}_clicks, coalesce(s_{label}.impressions, 0) AS {label}_impressions, {r(f's_{label}.position', 1)} AS {label}_position, coalesce(a_{label}.sessions, 0) AS {label}_sessions, coalesce(a_{label}.conversions, 0) AS {label}_conversions,
        CASE WHEN s_{label}.impressions > 0 THEN {r(f's_{label}.clicks / s_{label}.impressions', 4)} END AS {label}_ctr"""


_side = lambda label, low, high: f"""
   LEFT JOIN (SELECT k.page_id, k.deployed_at, k.checkpoint_day, sum(clicks) AS clicks, sum(impressions) AS impressions, avg(position) AS position FROM keys k JOIN gsc_mat g ON g.page_id = k.page_id AND g.date >= {low} AND g.date < {high} GROUP BY ALL) s_{label} ON s_{label}.page_id = c.page_id AND s_{label}.deployed_at = c.deployed_at AND s_{label}.checkpoint_day = c.checkpoint_day
   LEFT JOIN (SELECT k.page_id, k.deployed_at, k.checkpoint_day, sum(sessions) AS sessions, sum(conversions) AS conversions FROM keys k JOIN ga4_mat g ON g.page_id = k.page_id AND g.date >= {low} AND g.date < {high} GROUP BY ALL) a_{label} ON a_{label}.page_id = c.page_id AND a_{label}.deployed_at = c.deployed_at AND a_{label}.checkpoint_day = c.checkpoint_day"""
common("due_checkpoint", "SELECT * FROM {checkpoint} WHERE status = 'monitoring' AND measured_at IS NULL AND due_date <= DATE '2001-08-01'")
common(
    "window_pair",
    f"""SELECT * FROM (WITH keys AS (SELECT DISTINCT page_id, deployed_at, checkpoint_day FROM {{due_checkpoint}} WHERE page_id IS NOT NULL), gsc_mat AS MATERIALIZED (SELECT * FROM {{gsc}}), ga4_mat AS MATERIALIZED (SELECT * FROM {{ga4}})
        SELECT c.*, {window_sql('baseline', '', '')}, {window_sql('actual', '', '')} FROM {{due_checkpoint}} c {_side('baseline', 'k.deployed_at - k.checkpoint_day', 'k.deployed_at')} {_side('actual', 'k.deployed_at', 'k.deployed_at + k.checkpoint_day')})""",
)
_pct = lambda c: f"CASE WHEN baseline_{c} <> 0 THEN (actual_{c} - baseline_{c}) / baseline_{c} END"
_sig = lambda c, base: f"CASE WHEN ({_pct(c)}) IS NOT NULL AND {base} >= 20 AND abs({r(_pct(c), 8)}) >= 0.05 THEN CASE WHEN ({_pct(c)}) > 0 THEN 1 ELSE -1 END ELSE 0 END"
common(
    "measured",
    f"""SELECT *, CASE WHEN actual_impact = 'insufficient_data' THEN NULL WHEN predicted_impact = actual_impact THEN TRUE WHEN predicted_impact = 'mixed' THEN actual_impact <> 'neutral' ELSE FALSE END AS prediction_matched FROM (
        SELECT *, CASE WHEN page_id IS NULL OR NOT (baseline_impressions > 0 OR baseline_sessions > 0) OR NOT (actual_impressions > 0 OR actual_sessions > 0) THEN 'insufficient_data' WHEN len(list_filter(votes, lambda v: v <> 0)) = 0 THEN 'neutral' WHEN list_sum(votes) >= 2 THEN 'positive' WHEN list_sum(votes) <= -2 THEN 'negative'
          WHEN list_contains(votes, 1) AND list_contains(votes, -1) THEN 'mixed' WHEN list_sum(votes) > 0 THEN 'positive' ELSE 'negative' END AS actual_impact FROM (
        SELECT *, [{_sig('impressions', 'baseline_impressions')}, {_sig('clicks', 'baseline_clicks')}, {_sig('sessions', 'baseline_sessions')}, {_sig('conversions', 'baseline_conversions')}, {_sig('ctr', 'baseline_impressions')},
          CASE WHEN baseline_position > 0 AND actual_position IS NOT NULL AND baseline_impressions >= 20 AND abs({r('actual_position - baseline_position', 6)}) >= 0.5 THEN CASE WHEN actual_position > baseline_position THEN -1 ELSE 1 END ELSE 0 END] AS votes FROM {{window_pair}}))""",
)


def measured(t):
    return xp.measure_due(t.checkpoint, gsc(t), ga4(t), today="2001-08-01")


WINDOWS = [f"{s}_{c}" for s in ("baseline", "actual") for c in ("clicks", "impressions", "ctr", "position", "sessions", "conversions")]


@query("jn11_checkpoint_windows", f"SELECT experiment_id, checkpoint_day, page_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in WINDOWS)} FROM {{window_pair}}")
def _(t):
    due = xp.due_checkpoints(t.checkpoint, "2001-08-01")
    return xp.checkpoint_windows(due, gsc(t), ga4(t)).select("experiment_id", "checkpoint_day", "page_id", *WINDOWS)


@query("scl43_checkpoint_verdict", "SELECT experiment_id, checkpoint_day, page_id, array_to_string(votes, ',') AS votes, actual_impact, prediction_matched FROM {measured}")
def _(t):
    return measured(t).select("experiment_id", "checkpoint_day", "page_id", F.array_join(F.transform("votes", lambda v: v.cast("string")), ",").alias("votes"), "actual_impact", "prediction_matched")


@query(
    "pipe11_checkpoint_sweep",
    """SELECT actual_impact, predicted_impact, count(*) AS checkpoints, count(*) FILTER (WHERE prediction_matched) AS matched FROM {measured} GROUP BY ALL""",
)
def _(t):
    return measured(t).groupBy("actual_impact", "predicted_impact").agg(F.count(F.lit(1)).alias("checkpoints"), F.count_if("prediction_matched").alias("matched"))


@query(
    "pipe11_completed_experiments",
    "SELECT experiment_id FROM {checkpoint} WHERE status = 'monitoring' GROUP BY experiment_id HAVING bool_and(measured_at IS NOT NULL OR due_date <= DATE '2001-08-01') AND bool_or(measured_at IS NULL AND due_date <= DATE '2001-08-01')",
)
def _(t):
    return xp.completed_experiments(t.checkpoint, "2001-08-01")


common(
    "accuracy",
    f"""SELECT *, total_measured - insufficient_data AS evaluable, CASE WHEN total_measured - insufficient_data >= 10 THEN {r('matched / (total_measured - insufficient_data)', 3)} END AS accuracy_rate FROM (
        SELECT site_id, 'site' AS scope, NULL AS value, count(*) AS total_measured, count(*) FILTER (WHERE actual_impact = 'insufficient_data') AS insufficient_data, count(*) FILTER (WHERE prediction_matched) AS matched FROM {{measured}} GROUP BY site_id
        UNION ALL SELECT site_id, 'predicted_impact', predicted_impact, count(*), count(*) FILTER (WHERE actual_impact = 'insufficient_data'), count(*) FILTER (WHERE prediction_matched) FROM {{measured}} GROUP BY site_id, predicted_impact
        UNION ALL SELECT site_id, 'risk_level', coalesce(predicted_risk_level, 'unknown'), count(*), count(*) FILTER (WHERE actual_impact = 'insufficient_data'), count(*) FILTER (WHERE prediction_matched) FROM {{measured}} GROUP BY 1, 2, 3)
      WHERE scope = 'site' OR total_measured > insufficient_data""",
)


@query("agg17_prediction_accuracy", "SELECT site_id, scope, value, total_measured, insufficient_data, matched, accuracy_rate FROM {accuracy}")
def _(t):
    return xp.accuracy_report(measured(t)).select("site_id", "scope", "value", "total_measured", "insufficient_data", "matched", "accuracy_rate")


@query("agg17_weight_advice", "SELECT site_id, CASE WHEN evaluable < 10 THEN 'hold' ELSE 'decrease' END AS direction FROM {accuracy} WHERE scope = 'site' AND (evaluable < 10 OR accuracy_rate < 0.5)")
def _(t):
    return xp.weight_advice(xp.accuracy_report(measured(t))).select("site_id", "direction")


# ── events that affect a page ────────────────────────────────────────────────
VIEWS["site_event"] = """
    SELECT o_orderkey AS event_id, CAST(1 + o_orderkey % 25 AS INT) AS site_id, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE p.url END AS affected_url FROM {orders} JOIN {page} p ON p.page_id = o_custkey"""


@query(
    "jn14_events_of_page",
    """SELECT page_id, event_id, rn AS event_rank FROM (SELECT p.page_id, e.event_id, row_number() OVER (PARTITION BY p.page_id ORDER BY e.event_id DESC) AS rn FROM {page} p JOIN {site_event} e ON e.site_id = p.site_id AND (e.affected_url IS NULL OR e.affected_url = p.url)) WHERE rn <= 5""",
)
def _(t):
    events = t.site_event.withColumn("affected_urls", F.when(F.col("affected_url").isNotNull(), F.array("affected_url")))
    return plan.events_of_pages(t.page, events)
