"""Page lists, summaries, distributions, portfolio and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import SEVERITIES, lookup, num, rnd, severity_name, severity_rank
from ..operators.ranking import newest_per_key, row_numbers, top_per_key
from .roadmap import level_rank

# Sortable page columns, metric sorts.
PAGE_SORTS = (
    "priority_score", "seo_score", "traffic_potential_score", "lead_potential_score", "issue_count", "url", "last_crawled_at", "status_code",
)
METRIC_SORTS = ("users", "sessions", "conversions", "revenue", "clicks", "impressions")
_SEVERITY_ORDER = {s: i for i, s in enumerate(SEVERITIES, start=1)}


def filter_pages(
    pages: DataFrame,
    *,
    issues: DataFrame | None = None,
    include_inactive: bool = False,
    search: str | None = None,
    seo_category: str | None = None,
    severity: str | None = None,
    priority_band: str | None = None,
    ai_status: str | None = None,
    status_code: int | None = None,
    min_seo_score: float | None = None,
    max_seo_score: float | None = None,
    min_priority_score: float | None = None,
    has_issues: bool | None = None,
    rule_id: str | None = None,
) -> DataFrame:
    """The page table's filters; every one is a plain predicate that reaches the scan."""
    tests: list[Column] = [] if include_inactive else [F.col("is_active")]
    if search:
        needle = search.strip().lower()
        tests.append(F.lower("url").contains(needle) | F.coalesce(F.lower("title").contains(needle), F.lit(False)))
    for column, value in (
        ("seo_category", seo_category and seo_category.upper()),
        ("highest_severity", severity and severity.upper()),
        ("priority_band", priority_band and priority_band.upper()),
        ("ai_status", ai_status and ai_status.lower()),
        ("status_code", status_code),
    ):
        if value is not None:
            tests.append(F.col(column) == value)
    if min_seo_score is not None:
        tests.append(F.col("seo_score") >= min_seo_score)
    if max_seo_score is not None:
        tests.append(F.col("seo_score") <= max_seo_score)
    if min_priority_score is not None:
        tests.append(F.col("priority_score") >= min_priority_score)
    if has_issues is not None:
        tests.append(F.col("issue_count") > 0 if has_issues else F.col("issue_count") == 0)
    out = pages
    for test in tests:
        out = out.filter(test)
    return out if rule_id is None else pages_with_rule(out, issues, rule_id)


def pages_with_rule(pages: DataFrame, issues: DataFrame, rule_id: str) -> DataFrame:
    """Pages that carry an open issue of the rule."""
    hit = issues.filter((F.col("rule_id") == rule_id) & ~F.col("is_resolved"))
    return pages.join(hit.select("page_id"), "page_id", "left_semi")


def metric_totals(pages: DataFrame, gsc: DataFrame, ga4: DataFrame, since: Column) -> DataFrame:
    """Pages with window sums, missing = 0; both facts are aggregated before the join."""
    activity = ga4.filter(F.col("date") >= since).groupBy("page_id").agg(*[F.sum(c).alias(c) for c in METRIC_SORTS[:4]])
    search = gsc.filter(F.col("date") >= since).groupBy("page_id").agg(*[F.sum(c).alias(c) for c in METRIC_SORTS[4:]])
    return pages.join(activity, "page_id", "left").join(search, "page_id", "left").fillna(0, list(METRIC_SORTS))


def page_order(sort: str = "priority_score", descending: bool = True) -> list[Column]:
    """Sort keys of the page table; ties fall to traffic, urgency and at last the id."""
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    urgency = lookup(F.coalesce("highest_severity", F.lit("")), _SEVERITY_ORDER, 5)
    if sort in METRIC_SORTS:
        return [way(sort), F.col("page_id").asc()]
    if sort == "severity":
        return [urgency.asc() if descending else urgency.desc(), F.col("page_id").asc()]
    main = F.col(sort if sort in PAGE_SORTS else "priority_score")
    return [
        main.desc_nulls_last() if descending else main.asc_nulls_first(),
        *[way(c) for c in ("clicks", "impressions", "users", "conversions")],
        urgency.asc(),
        F.col("seo_score").asc_nulls_first(),
        F.col("page_id").asc(),
    ]


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows of one result page, one-row total); enrich the rows afterwards, not before."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total"))


def fix_first(pages: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` active pages of each site with the highest priority."""
    known = pages.filter("is_active and priority_score is not null")
    return top_per_key(known, ["site_id"], [F.col("priority_score").desc(), F.col("page_id").asc()], limit, "place")


def top_issues(issues: DataFrame, k: int = 3) -> DataFrame:
    """Titles of the ``k`` most severe open issues of each page."""
    order = [severity_rank("severity").desc(), F.col("issue_id").asc()]
    best = top_per_key(issues.filter("not is_resolved").select("page_id", "severity", "issue_id", "title"), ["page_id"], order, k, "_r")
    return best.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("top_issues"))


# ── lists ────────────────────────────────────────────────────────────────────
def issue_list(open_issues: DataFrame, *, severity: str | None = None, rule_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Open issues of active pages, by page priority (unknown last), then id."""
    out = open_issues
    if severity:
        out = out.filter(F.col("severity") == severity.upper())
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    out = out.orderBy(F.col("priority_score").desc_nulls_last(), F.col("issue_id").asc())
    return out if limit is None else out.limit(limit)


def opportunity_list(scores: DataFrame, pages: DataFrame, *, level: str | None = None, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Scored recommendations with their page, best first."""
    out = scores
    for column, value in (("priority_level", level and level.upper()), ("recommendation_type", kind), ("status", status)):
        if value:
            out = out.filter(F.col(column) == value)
    return out.join(pages.select("page_id", "url", "path"), "page_id").orderBy(F.col("overall_priority").desc_nulls_last(), F.col("score_id").asc())


def opportunity_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("site_id").agg(*[F.count_if(F.col("priority_level") == b).alias(b) for b in ("P0", "P1", "P2", "P3")])


def mismatch_list(profiles: DataFrame, pages: DataFrame, *, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Pages whose intent conflicts, most severe first, then keyword score. Sorted before any limit."""
    out = profiles.filter("intent_mismatch")
    if severity:
        out = out.filter(F.col("mismatch_severity") == severity.upper())
    out = out.join(pages.select("page_id", "url"), "page_id")
    out = out.orderBy(level_rank("mismatch_severity").asc(), num("keyword_opportunity_score").desc(), F.col("page_id").asc())
    return out if limit is None else out.limit(limit)


def site_search(sites: DataFrame, *, search: str | None = None, is_active: bool | None = None) -> DataFrame:
    out = sites
    if search:
        needle = search.strip().lower()
        out = out.filter(F.lower("name").contains(needle) | F.lower("domain").contains(needle))
    if is_active is not None:
        out = out.filter(F.col("is_active") == is_active)
    return out.orderBy("name")


def recommendation_list(findings: DataFrame, pages: DataFrame, *, status: str = "completed", priority: str | None = None) -> DataFrame:
    """Findings with their page and number of entries, by page priority."""
    out = findings.filter(F.col("status") == status)
    if priority:
        out = out.filter(F.col("priority") == priority.lower())
    rows = out.join(pages.select("page_id", "url", "priority_score"), "page_id").withColumn("finding_count", F.size("findings"))
    return rows.orderBy(F.col("priority_score").desc_nulls_last(), F.col("finding_id").desc())


def compact_evidence(evidence: Column | str = "evidence", limit: int | None = None) -> Column:
    """One line of ``key: value`` pairs; ``limit`` cuts it for display, and a cut line ends in an ellipsis."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    pairs = F.transform(F.map_entries(F.coalesce(e, F.create_map().cast("map<string,string>"))), lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(x["value"], F.lit("None"))))
    line = F.array_join(pairs, "; ")
    return line if limit is None else F.when(F.char_length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


# ── summaries ────────────────────────────────────────────────────────────────
def issue_summary(open_issues: DataFrame) -> DataFrame:
    """Per site and rule: issues, pages and the worst severity; page counts add up over severities and titles."""
    split = open_issues.groupBy("site_id", "rule_id", "title", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("p"), F.min("issue_id").alias("_first")
    )
    out = split.groupBy("site_id", "rule_id").agg(
        F.min_by("title", "_first").alias("title"),
        F.max(severity_rank("severity")).alias("_rank"),
        F.sum("n").alias("issue_count"),
        F.sum("p").alias("page_count"),
    )
    return out.withColumn("severity", severity_name(F.col("_rank")))


def severity_summary(open_issues: DataFrame) -> DataFrame:
    return open_issues.groupBy("site_id", "severity").agg(F.count(F.lit(1)).alias("issue_count"))


def top_rules(summary: DataFrame, k: int = 10) -> DataFrame:
    order = [F.col("_rank").desc(), F.col("page_count").desc(), F.col("rule_id").asc()]
    return top_per_key(summary, ["site_id"], order, k, "place")


def status_class(code: Column | str = "status_code") -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return (
        F.when(c.between(200, 299), "2xx").when(c.between(300, 399), "3xx").when(c.between(400, 499), "4xx").when(c >= 500, "5xx").otherwise("unreachable")
    )


def distributions(pages: DataFrame, open_issues: DataFrame) -> DataFrame:
    """(site, dimension, value, n) for category, band, model status, HTTP class and issue severity."""
    rows = pages.filter("is_active").withColumn("status_class", status_class())
    names = ("seo_category", "priority_band", "ai_status", "status_class")
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in names])
    page_rows = rows.select("site_id", F.explode(pairs).alias("d")).select("site_id", "d.*")
    issue_rows = open_issues.select("site_id", F.lit("issue_severity").alias("dimension"), F.col("severity").alias("value"))
    both = page_rows.unionByName(issue_rows).filter("value is not null and value <> ''")
    return both.groupBy("site_id", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def portfolio(
    sites: DataFrame, pages: DataFrame, open_issues: DataFrame, gsc: DataFrame, ga4: DataFrame, connections: DataFrame, runs: DataFrame, since: Column
) -> DataFrame:
    """One row per site: health, open issues, bands, window traffic (null when not connected) and the active run."""
    by_page = pages.filter("is_active").groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        rnd(F.avg("seo_score"), 1).alias("average_seo_score"),
        F.count_if(F.col("priority_band") == "P0").alias("p0_pages"),
        F.count_if(F.col("priority_band") == "P1").alias("p1_pages"),
    )
    by_issue = open_issues.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_issues"),
        F.count_if(F.col("severity") == "HIGH").alias("high_issues"),
    )
    recent = F.col("date") >= since
    traffic = ga4.filter(recent).groupBy("site_id").agg(*[F.sum(c).alias(c) for c in ("users", "sessions", "conversions", "revenue")])
    search = gsc.filter(recent).groupBy("site_id").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    active = newest_per_key(runs.filter(F.col("run_status").isin("queued", "running")), ["site_id"], ["run_id"])
    counts = ("total_pages", "p0_pages", "p1_pages", "total_issues", "critical_issues", "high_issues", "clicks", "impressions")
    out = sites
    for side in (by_page, by_issue, traffic, search, connections, active.select("site_id", F.col("run_id").alias("active_run"))):
        out = out.join(side, "site_id", "left")
    connected = F.col("ga4_status") == "connected"
    for c in ("users", "sessions", "conversions", "revenue"):
        out = out.withColumn(c, F.when(F.col(c).isNull() & connected, F.lit(0)).otherwise(F.col(c)))
    return out.fillna(0, list(counts)).withColumn("high_priority_pages", F.col("p0_pages") + F.col("p1_pages"))


def portfolio_order() -> list[Column]:
    return [F.col("p0_pages").desc(), F.col("critical_issues").desc(), F.lower("name").asc()]


def portfolio_totals(overview: DataFrame) -> DataFrame:
    """One grand-total row; the mean runs over sites that have a score."""
    sums = ("total_pages", "critical_issues", "high_priority_pages", "total_issues", "clicks", "impressions")
    return overview.agg(
        F.count(F.lit(1)).alias("websites"),
        *[F.sum(c).alias(c) for c in sums],
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        *[rnd(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(c) for c in ("conversions", "revenue")],
        rnd(F.avg("average_seo_score"), 1).alias("average_seo_score"),
    )


def keyword_catalogue(keywords: DataFrame, pages: DataFrame, *, tier: str | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(keywords, members): per site and keyword the best row and the number of pages; every page is a member row."""
    rows = keywords
    if tier:
        rows = rows.filter(F.col("keyword_tier") == tier)
    if search:
        rows = rows.filter(F.lower("keyword").contains(search.lower()))
    rows = rows.join(pages.select("page_id", "url", "path"), "page_id")
    score = num("keyword_opportunity_score")
    best = F.struct(score.alias("s"), (-F.col("page_id")).alias("p"), (-F.col("row_id")).alias("r"))
    payload = F.struct("page_id", "url", "keyword_tier", "demand_score", "current_position")
    out = rows.groupBy("site_id", "keyword").agg(
        F.max(score).alias("keyword_opportunity_score"), F.count(F.lit(1)).alias("page_count"), F.max_by(payload, best).alias("best")
    )
    return out, rows


def page_dossier(pages: DataFrame, issues: DataFrame, audits: DataFrame, metrics: DataFrame, scores: DataFrame, findings: DataFrame) -> DataFrame:
    """Everything known about each page: newest issue per rule, checks, metrics, score breakdown, finding.

    A page has at most one open issue per rule, so its issue list is bounded by the registry.
    """
    per_rule = newest_per_key(
        issues.filter("not is_resolved").select("page_id", "rule_id", "issue_id", "severity", "title"), ["page_id", "rule_id"], ["issue_id"]
    )
    entry = F.struct((-severity_rank("severity")).alias("_o"), F.col("rule_id"), F.col("issue_id"), F.col("severity"), F.col("title"))
    listed = per_rule.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("issues"))
    newest = lambda df, by, columns: newest_per_key(df.select("page_id", by, *columns), ["page_id"], [by])
    return (
        pages.join(listed, "page_id", "left")
        .join(newest(audits, "audit_id", ["checks"]).drop("audit_id"), "page_id", "left")
        .join(metrics, "page_id", "left")
        .join(newest(scores, "priority_id", ["score", "band"]).drop("priority_id"), "page_id", "left")
        .join(newest(findings, "finding_id", ["payload"]), "page_id", "left")
    )


ACTION_ORDER = ("score_id", "recommendation_type")  # ties after the priority


def action_rows(scores: DataFrame) -> DataFrame:
    """Every stored recommendation as a row with its place among those of its page, best first."""
    order = [num("overall_priority").desc(), *[F.col(c).asc() for c in ACTION_ORDER]]
    rows = scores.select("page_id", "score_id", "recommendation_type", "priority_level", "overall_priority", "effort", "reason", "status")
    return row_numbers(rows, ["page_id"], order, "action_rank")


def action_plan(
    pages: DataFrame, metrics: DataFrame, profiles: DataFrame, scores: DataFrame, competitors: DataFrame, *, listed: int | None = None
) -> DataFrame:
    """One row per page: metrics, intent, keywords, newest competitor analysis, number of actions and the first of them.

    With ``listed`` the best so many actions also come as an array; :func:`action_rows` has them all.
    """
    action = F.struct("score_id", "recommendation_type", "priority_level", "overall_priority", "effort", "reason", "status")
    best = F.struct((-num("overall_priority")).alias("_o"), *ACTION_ORDER)
    actions = scores.groupBy("page_id").agg(F.count(F.lit(1)).alias("action_count"), F.min_by(action, best).alias("first_action"))
    if listed is not None:
        order = [num("overall_priority").desc(), *[F.col(c).asc() for c in ACTION_ORDER]]
        top = top_per_key(scores, ["page_id"], order, listed, "_k").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_k", action.alias("a")))).alias("_top"))
        actions = actions.join(top.select("page_id", F.transform("_top", lambda x: x["a"]).alias("recommended_actions")), "page_id")
    newest = newest_per_key(competitors.select("page_id", "analysis_id", "keyword", "median_word_count"), ["page_id"], ["analysis_id"])
    profile = profiles.select("page_id", "detected_intent", "intent_mismatch", "mismatch_explanation", "primary_keywords", "secondary_keywords", "keyword_opportunity_score")
    keep = ["page_id", "impressions", "clicks", "ctr", "position", "sessions", "engagement_rate", "conversions", "revenue"]
    return (
        pages.select("site_id", "page_id", "url", "seo_score")
        .join(metrics.select(*keep), "page_id", "left")
        .join(profile, "page_id", "left")
        .join(newest, "page_id", "left")
        .join(actions, "page_id", "left")
        .fillna(0, ["action_count"])
        .withColumns({"intent_mismatch": F.coalesce("intent_mismatch", F.lit(False)), "competitors_available": F.col("analysis_id").isNotNull()})
    )


def newest_rows(rows: DataFrame, newest: list[str]) -> DataFrame:
    """Newest row of every page, by date or id, with a deterministic tie-break."""
    return newest_per_key(rows, ["page_id"], newest)


# ── exports ──────────────────────────────────────────────────────────────────
def audit_report(pages: DataFrame, open_issues: DataFrame, findings: DataFrame, keywords: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """The five result tables of a site export; ``operators.exports.write_tables`` writes them."""
    active = pages.filter("is_active")
    summary = active.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pages"), rnd(F.avg("seo_score"), 1).alias("average_seo_score"), F.sum("issue_count").alias("issues")
    )
    issue_table = open_issues.join(active.select("page_id"), "page_id", "left_semi")
    if "evidence" in issue_table.columns:
        issue_table = issue_table.withColumn("evidence", compact_evidence())
    return {
        "summary": summary,
        "page_overview": active.join(metrics.drop(*[c for c in metrics.columns if c in active.columns and c != "page_id"]), "page_id", "left"),
        "issues": issue_table,
        "findings": newest_per_key(findings.filter("status = 'completed'"), ["page_id"], ["finding_id"]).join(active.select("page_id"), "page_id", "left_semi"),
        "keywords": keywords.join(active.select("page_id", "url"), "page_id"),
    }


def issue_export(
    pages: DataFrame, issues: DataFrame, rule_id: str, metrics: DataFrame, profiles: DataFrame, *, sort: str = "priority_score", descending: bool = True, **filters
) -> DataFrame:
    """Every page a rule affects, in table order, with metrics, top issues and intent."""
    hits = filter_pages(pages, issues=issues, rule_id=rule_id, **filters)
    extra = metrics.select("page_id", "users", "sessions", "conversions", "revenue", "clicks", "impressions", "ctr", "position")
    rows = hits.join(extra, "page_id", "left").join(top_issues(issues), "page_id", "left").join(profiles.select("page_id", "detected_intent", "primary_keywords"), "page_id", "left")
    return rows.orderBy(*page_order(sort, descending)).select(
        "site_id", "page_id", "url", "title", "seo_score", "priority_score", "priority_band", "highest_severity", "issue_count", "users", "sessions", "clicks",
        "impressions", "detected_intent", F.array_join("top_issues", "; ").alias("top_issues"),
    )
