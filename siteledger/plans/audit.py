"""Site audit: link counts, duplicate groups, rules, scores and their persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import SEVERITIES, SEVERITY_RANK, health_category, lookup, num, rnd, severity_name, severity_rank, technical_band
from ..functions.urls import normalize_url, url_path
from ..operators import rules
from ..operators.joins import HEAVY_ROWS, heavy_join
from ..operators.ranking import newest_per_key, top_per_key
from ..session import cut
from ..sources.html import has_document, is_usable

# Configured weight per check type (overrides the registered weight).
CHECK_WEIGHTS = {
    "http_status": 10.0,
    "robots": 10.0,
    "canonical": 5.0,
    "title": 8.0,
    "meta_description": 7.0,
    "h1": 10.0,
    "heading_structure": 5.0,
    "content": 20.0,
    "image_alt": 10.0,
    "internal_links": 5.0,
    "broken_links": 5.0,
    "url_structure": 2.0,
    "structured_data": 1.5,
    "open_graph": 1.5,
    "redirect_chain": 4.0,
    "canonical_target": 4.0,
    "hreflang": 1.0,
    "viewport": 1.0,
    "duplicate_title": 3.0,
    "duplicate_meta_description": 2.0,
    "duplicate_content": 4.0,
    "orphan_page": 2.0,
    "external_links": 1.0,
}
EXAMPLES = 5
CRAWL_COLUMNS = {"final_url": "string", "redirect_chain": "array<string>", "crawl_error": "string"}
TEXTS = ("html", "content", "raw_text", "visible_text")
MIN_DUPLICATE_WORDS = 50


def effective_url() -> Column:
    return F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))


# ── link graph ───────────────────────────────────────────────────────────────
def link_edges(pages: DataFrame) -> DataFrame:
    """(source url, normalised target) per internal link occurrence."""
    return pages.select("url", F.explode("internal_links").alias("_t")).select("url", normalize_url("_t").alias("target"))


def link_counts(edges: DataFrame, pages: DataFrame, *, limit: int = HEAVY_ROWS) -> DataFrame:
    """Per page url: broken outgoing links and distinct linking pages.

    Occurrences collapse to (source, target, n) before any join, and a target's inbound count is a partial sum. A target that more
    than ``limit`` pages link to, such as a broken link in the navigation, meets the status table in several tasks.
    A page counts under its own and its final url and takes the larger figure.
    """
    pairs = cut(edges.groupBy("url", "target").agg(F.count(F.lit(1)).alias("n")))
    inbound = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("_in"))
    statuses = (
        pages.select(F.explode(F.array_distinct(F.array("url", effective_url()))).alias("target"), "status_code")
        .groupBy("target")
        .agg(F.max("status_code").alias("status_code"))
    )
    faulty = statuses.filter("status_code >= 400").select("target")
    linked = heavy_join(pairs, faulty, ["target"], limit=limit, sizes=inbound.withColumnRenamed("_in", "rows"), spread=["url"])
    broken = linked.groupBy("url").agg(F.sum("n").alias("broken_link_count"))
    seen = (
        pages.select("url", F.explode(F.array_distinct(F.array("url", effective_url()))).alias("target"))
        .join(inbound, "target")
        .groupBy("url")
        .agg(F.max("_in").alias("inbound_internal_links"))
    )
    return (
        pages.select("url").distinct()
        .join(broken, "url", "left")
        .join(seen, "url", "left")
        .fillna(0, ["broken_link_count", "inbound_internal_links"])
    )


# ── duplicates ───────────────────────────────────────────────────────────────
def duplicate_keys() -> dict[str, Column]:
    """What pages of a site may share: title, description, content of enough words."""
    text_key = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    content = F.when(F.coalesce("word_count", F.lit(0)) >= MIN_DUPLICATE_WORDS, F.col("content_hash"))
    return {"title": text_key("title"), "meta": text_key("meta_description"), "content": content}


def duplicate_signals(pages: DataFrame, *, limit: int = HEAVY_ROWS) -> DataFrame:
    """Per (site_id, url, digests of the keys): size of the page's group and up to five other URLs, for every kind of key.

    One narrow row per page and key, with the key as a digest. Group sizes are partial counts; the examples are the six smallest
    URLs of a group, each as often as pages have it but five times at most, pruned before the shuffle, so a group holding a third
    of the site is never gathered, and one of more than ``limit`` pages is joined in parts. Pages without a key are in no group.
    """
    kinds = list(duplicate_keys())
    mine = ["site_id", "url", *[f"_{k}_key" for k in kinds]]
    keyed = with_duplicate_keys(pages).select(*mine, effective_url().alias("_u"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}_key").alias("key")) for k in kinds])
    long = cut(keyed.select(*mine, "_u", F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p")).select(*mine, "_u", "p.*"))
    group = ["site_id", "kind", "key"]
    sizes = long.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    urls = long.groupBy(*group, "_u").agg(F.least(F.count(F.lit(1)), F.lit(EXAMPLES)).cast("int").alias("_times"))
    times = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_u", "_times"))), lambda x: F.array_repeat(x["_u"], x["_times"])))
    samples = top_per_key(urls, group, [F.col("_u").asc()], EXAMPLES + 1).groupBy(*group).agg(times.alias("sample"))
    groups = cut(sizes.join(samples, group))
    found = heavy_join(long, groups, group, limit=limit, sizes=groups.select(*group, "rows"), spread=["url"])
    others = F.slice(F.filter("sample", lambda u: u != F.col("_u")), 1, EXAMPLES)
    found = found.withColumn("g", F.struct("rows", others.alias("others")))
    return found.groupBy(*mine).agg(*[F.max(F.when(F.col("kind") == k, F.col("g"))).alias(f"_{k}") for k in kinds])


def with_duplicate_keys(pages: DataFrame) -> DataFrame:
    return pages.withColumns({f"_{k}_key": F.unhex(F.sha2(key.cast("binary"), 256)) for k, key in duplicate_keys().items()})


def _settle_duplicates(rows: DataFrame) -> DataFrame:
    kinds = list(duplicate_keys())
    out = {f"duplicate_{k}_count": F.coalesce(F.col(f"_{k}.rows"), F.lit(0)) for k in kinds} | {f"duplicate_{k}_examples": F.col(f"_{k}.others") for k in kinds}
    return rows.withColumns(out).drop(*[f"_{k}" for k in kinds], *[f"_{k}_key" for k in kinds])


def _meet(pages: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet."""
    renamed = signals.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in signals.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.equal_null(F.col(k), F.col(f"_j{i}"))
    return pages.join(renamed, same, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def annotate(pages: DataFrame, counts: DataFrame | None = None, *, limit: int = HEAVY_ROWS) -> DataFrame:
    """Duplicate title, description and content signals of every page within its site, and its link ``counts`` (by url) where given.

    Both are narrow; whole pages are shuffled once. Pages without any duplicate have no row there.
    """
    keyed = with_duplicate_keys(pages)
    found = duplicate_signals(pages, limit=limit)
    mine = ["site_id", "url", *[f"_{k}_key" for k in duplicate_keys()]]
    if counts is None:
        return _settle_duplicates(_meet(keyed, found, mine))
    narrow = _meet(keyed.select(*mine).distinct(), found, mine).join(counts, "url", "left")
    return _settle_duplicates(_meet(keyed, narrow, mine))


# ── rules and scores ─────────────────────────────────────────────────────────
def check_weights(overrides: dict[str, float] | None = None) -> dict[str, float]:
    return {**rules.registered_weights(), **CHECK_WEIGHTS, **(overrides or {})}


def run_checks(annotated: DataFrame) -> DataFrame:
    """Add ``checks``: every rule's outcome in one wide projection."""
    status = F.coalesce("status_code", F.lit(200))
    usable = is_usable(status, F.coalesce("crawl_quality", F.lit("ok")))
    absent = {c: F.lit(None).cast(kind) for c, kind in CRAWL_COLUMNS.items() if c not in annotated.columns}
    if "content_size" not in annotated.columns:
        absent["content_size"] = F.length("content")
    return rules.apply_rules(annotated.withColumns(absent) if absent else annotated, (status == 200) & usable, status, usable)


def _issues() -> Column:
    return F.filter("checks", lambda c: ~c["status"].isin("pass", "skipped") & c["severity"].isNotNull())


def score_checks(checked: DataFrame, weights: dict[str, float] | None = None, site_weights: DataFrame | None = None) -> DataFrame:
    """Add score, category, severity counts, worst severity and technical band.

    ``site_weights`` is (site_id, weights map<string,double>) for per-site overrides. The weighted mean
    folds over the checks array of the row, so scoring needs no shuffle.
    """
    base = F.create_map(*[x for k, v in check_weights(weights).items() for x in (F.lit(k), F.lit(float(v)))])
    if site_weights is not None:
        checked = checked.join(site_weights.select("site_id", F.col("weights").alias("_sw")), "site_id", "left")
        weight = lambda c: F.coalesce(F.try_element_at("_sw", c["check_type"]), F.try_element_at(base, c["check_type"]), F.lit(0.0))
    else:
        weight = lambda c: F.coalesce(F.try_element_at(base, c["check_type"]), F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))

    def add(acc: Column, c: Column) -> Column:
        w = F.when(c["status"] == "skipped", 0.0).otherwise(F.greatest(F.lit(0.0), weight(c)))
        return F.struct((acc["w"] + w).alias("w"), (acc["s"] + w * c["score"]).alias("s"))

    out = checked.withColumns({"_sum": F.aggregate("checks", start, add), "issues": _issues()})
    count = lambda s: F.size(F.filter("issues", lambda c: F.upper(c["severity"]) == s))
    out = out.withColumns(
        {
            "seo_score": F.when(F.col("_sum.w") > 0, rnd(F.col("_sum.s") / F.col("_sum.w"), 1)).otherwise(F.lit(0.0)),
            **{f"{s.lower()}_count": count(s) for s in SEVERITIES},
            "issue_count": F.size("issues"),
            "highest_severity": severity_name(
                F.coalesce(F.array_max(F.transform("issues", lambda c: severity_rank(c["severity"]))), F.lit(0))
            ),
        }
    )
    return out.withColumns(
        {"seo_category": health_category("seo_score"), "technical_band": technical_band("highest_severity")}
    ).drop("_sum", "_sw")


def audit_pages(
    pages: DataFrame, edges: DataFrame | None = None, weights: dict[str, float] | None = None, site_weights: DataFrame | None = None, *, texts: bool = False
) -> DataFrame:
    """The whole audit of extracted pages: links, duplicates, rules and scores.

    ``pages`` is the extraction output plus site_id; extraction feeds several joins, so its signals are materialised once. Whole
    texts (``TEXTS``) stay out, as the rules need only their size; ``texts`` keeps them, for rules of one's own that read them.
    """
    absent = {c: F.lit(None).cast(kind) for c, kind in CRAWL_COLUMNS.items() if c not in pages.columns}
    signals = pages.withColumns(absent | {"content_size": F.length("content")})
    base = cut(signals if texts else signals.drop(*TEXTS))
    counts = link_counts(link_edges(base) if edges is None else edges, base)
    return score_checks(run_checks(annotate(base, counts)), weights, site_weights)


def issue_rows(audited: DataFrame, keys: tuple[str, ...] = ("site_id", "page_id")) -> DataFrame:
    """One row per issue, exploded after the wide pass."""
    return audited.select(*keys, F.explode("issues").alias("i")).select(*keys, "i.*")


def audit_totals(audited: DataFrame, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Per crawl: pages, mean score, issues, critical issues, pages by category and worst severity."""
    by = lambda column, value: F.count_if(F.col(column) == value)
    pairs = lambda column, values: F.map_filter(
        F.create_map(*[x for v in values for x in (F.lit(v), by(column, v))]), lambda k, v: v > 0
    )
    return audited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("page_count"),
        rnd(F.avg("seo_score"), 1).alias("average_seo_score"),
        F.sum("issue_count").alias("total_issues"),
        F.sum("critical_count").alias("critical_issues"),
        pairs("seo_category", ("LOW ISSUES", "MEDIUM ISSUES", "HIGH ISSUES")).alias("by_category"),
        pairs("highest_severity", (*SEVERITIES, "NONE")).alias("by_severity"),
    )


# ── persistence ──────────────────────────────────────────────────────────────
RESPONSE_COLUMNS = ("status_code", "final_url", "redirect_chain", "crawl_quality", "crawl_error")


def collapse_observations(observations: DataFrame) -> DataFrame:
    """One observation per (site, url hash): the latest fetch wins, for pages and audits alike.

    The URL tells rows apart as its hash does, so the many observations are sorted without a hash and only those that stay get one.
    """
    rows = observations.withColumn("url", normalize_url(effective_url()))
    rows = newest_per_key(rows.drop("url_hash"), ["site_id", "url"], ["fetched_at", "observation_id"])
    return rows.select("site_id", F.sha2("url", 256).alias("url_hash"), *[c for c in observations.columns if c not in ("site_id", "url_hash")])


def merge_snapshot(pages: DataFrame, observations: DataFrame, content_columns: list[str]) -> DataFrame:
    """Upsert collapsed observations into the page table.

    Response columns always follow the newest crawl; content columns and ``content_captured_at`` only
    when the observation holds a document. ``first_seen_at`` never changes. Unseen pages stay as they are.
    """
    # One column each, not a struct that is tested as a whole: columns that no result needs are then neither sorted nor shuffled.
    n = lambda c: F.col(f"`_n.{c}`")
    new = observations.select(
        "site_id", "url_hash", F.lit(True).alias("_seen"), *[F.col(f"`{c}`").alias(f"_n.{c}") for c in observations.columns if c not in ("site_id", "url_hash")]
    )
    joined = pages.join(new, ["site_id", "url_hash"], "full")
    seen = F.col("_seen").isNotNull()
    fresh = seen & has_document(n("status_code"), n("crawl_quality"))
    pick = lambda test, c: F.when(test, n(c)).otherwise(F.col(c)).alias(c)
    when = n("fetched_at")
    return joined.select(
        "site_id",
        "url_hash",
        pick(seen, "url"),
        F.when(seen, url_path(n("url"))).otherwise(F.col("path")).alias("path"),
        *[pick(seen, c) for c in RESPONSE_COLUMNS if c in pages.columns],
        *[pick(fresh, c) for c in content_columns],
        F.coalesce("first_seen_at", when).alias("first_seen_at"),
        F.coalesce(when, "last_seen_at").alias("last_seen_at"),
        F.when(fresh, when).otherwise(F.col("content_captured_at")).alias("content_captured_at"),
        F.when(seen, True).otherwise(F.col("is_active")).alias("is_active"),
    )


def missing_pages(pages: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Active pages a full, successful crawl no longer found.

    The guard is a per-site aggregate joined in: at least one response in 200..399 without an error.
    """
    good = F.col("status_code").between(200, 399) & F.col("crawl_error").isNull()
    reached = observations.groupBy("site_id").agg(F.max(good).alias("reached"))
    guard = runs.filter("mode = 'full'").select("site_id").distinct().join(reached.filter("reached"), "site_id", "left_semi")
    return (
        pages.filter("is_active")
        .join(guard, "site_id", "left_semi")
        .join(observations.select("site_id", "url_hash"), ["site_id", "url_hash"], "left_anti")
    )


def merge_issues(issues: DataFrame, audited: DataFrame, new_issues: DataFrame) -> DataFrame:
    """Open issues of every audited page become resolved, then the new ones are added open."""
    marks = audited.select("page_id").distinct().withColumn("_audited", F.lit(True))
    kept = issues.join(marks, "page_id", "left").withColumn("is_resolved", F.col("is_resolved") | F.coalesce("_audited", F.lit(False))).drop("_audited")
    return kept.unionByName(new_issues.withColumn("is_resolved", F.lit(False)), allowMissingColumns=True)


def parameter_variants(pages: DataFrame) -> DataFrame:
    """Every active page with ``keep``: per normalised URL the clean, then shortest, then oldest row stays.

    A variant whose normalised URL belongs to another stored row is switched off, active or not.
    """
    norm = F.sha2(normalize_url("url"), 256)
    rows = pages.withColumn("norm_hash", norm)
    order = F.struct(F.contains("url", F.lit("?")).alias("q"), F.length("url").alias("l"), "page_id")
    active = rows.filter("is_active")
    first = active.groupBy("site_id", "norm_hash").agg(F.min_by("page_id", order).alias("_first"))
    owners = pages.select("site_id", F.col("url_hash").alias("norm_hash")).distinct().withColumn("_owned", F.lit(True))
    own = F.col("url_hash") == F.col("norm_hash")
    keep = (F.col("page_id") == F.col("_first")) & (own | F.col("_owned").isNull())
    return active.join(first, ["site_id", "norm_hash"]).join(owners, ["site_id", "norm_hash"], "left").withColumn("keep", keep).drop("_first", "_owned")


def site_summary(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Per site: active pages, mean score, open critical issues, P0 and P1 pages."""
    active = pages.filter("is_active")
    base = active.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        rnd(F.avg("seo_score"), 1).alias("average_seo_score"),
        F.count_if(F.col("priority_band").isin("P0", "P1")).alias("high_priority_page_count"),
    )
    critical = open_issues(issues, pages).filter("severity = 'CRITICAL'").groupBy("site_id").agg(F.count(F.lit(1)).alias("critical_issue_count"))
    return base.join(critical, "site_id", "left").fillna(0, ["critical_issue_count"])


def open_issues(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Unresolved issues of active pages, with the page's site, priority and url."""
    side = pages.filter("is_active").select("page_id", "site_id", "priority_score", "url")
    return issues.filter("not is_resolved").drop("site_id").join(side, "page_id")


def agreement(ours: DataFrame, theirs: DataFrame, key: str, metrics: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Compare two measurements of the same pages metric by metric.

    ``expected`` is (key, metric) for differences known in advance. Values compare as text, null-safe.
    """

    def long(df: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias(value)) for m in metrics])
        return df.select(key, F.explode(pairs).alias("m")).select(key, "m.*")

    both = long(ours, "ours").join(long(theirs, "theirs"), [key, "metric"])
    if expected is None:
        both = both.withColumn("_expected", F.lit(False))
    else:
        both = both.join(expected.select(key, "metric").withColumn("_expected", F.lit(True)), [key, "metric"], "left").fillna(False, ["_expected"])
    same = F.equal_null("ours", "theirs")
    return both.groupBy("metric").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(same).alias("agreed"),
        F.count_if(~same & ~F.col("_expected")).alias("differing"),
        F.count_if(~same & F.col("_expected")).alias("expected_differences"),
    )
