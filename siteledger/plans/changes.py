"""What a push re-audits and what a pull request does to search: one job over all deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import changes as cx
from ..functions.numeric import rnd
from ..functions.urls import normalize_url
from ..operators.ranking import newest_per_key, row_numbers, top_per_key
from ..session import cut


def match_sites(deliveries: DataFrame, sites: DataFrame) -> DataFrame:
    """Repository (any case) and branch to site; without a branch the first candidate by id."""
    repo = sites.select(
        F.lower("github_repo").alias("_repo"), F.lower(F.coalesce("github_branch", F.lit("main"))).alias("_branch"), F.col("site_id")
    )
    exact = repo.groupBy("_repo", "_branch").agg(F.min("site_id").alias("_exact"))
    any_branch = repo.groupBy("_repo").agg(F.min("site_id").alias("_any"))
    rows = deliveries.withColumns({"_repo": F.lower("repository"), "_branch": F.lower("branch")})
    rows = rows.join(exact, ["_repo", "_branch"], "left").join(any_branch, "_repo", "left")
    site = F.when(F.col("branch").isNotNull(), F.col("_exact")).otherwise(F.col("_any"))
    return rows.withColumn("site_id", site).drop("_repo", "_branch", "_exact", "_any")


def mapped_files(files: Column, framework: Column, path_map: Column) -> Column:
    """Array of struct(path, ignored, explicit, global, route): a delivery's files stay in its row."""
    strip = lambda x: F.regexp_replace(x, "^/+|/+$", "")
    none = F.create_map().cast("map<string,string>")
    explicit = F.transform_keys(F.coalesce(path_map, none), lambda k, v: strip(k))
    return F.transform(
        files,
        lambda f: F.struct(
            f.alias("path"),
            cx.is_ignorable(f).alias("ignored"),
            F.try_element_at(explicit, strip(f)).alias("explicit"),
            cx.has_global_impact(f).alias("shared"),
            cx.route_of(f, framework).alias("route"),
        ),
    )


def push_scope(deliveries: DataFrame, sites: DataFrame, *, max_targets: int | None = None) -> DataFrame:
    """Action, reason and affected paths of every delivery.

    ``deliveries`` has event_type, site_id, repository, branch, deleted and files; ``sites`` adds
    base_url, is_active, framework and path_map. With ``max_targets``, a push that touches more pages asks for a full crawl.
    """
    rows = deliveries.join(sites.select("site_id", "base_url", "is_active", "framework", "path_map"), "site_id", "left")
    rows = rows.withColumn("_all", mapped_files(F.col("files"), F.col("framework"), F.col("path_map")))
    rows = rows.withColumn("_m", F.filter("_all", lambda f: ~f["ignored"]))
    target = lambda f: F.coalesce(f["explicit"], f["route"])
    rows = rows.withColumns(
        {
            "_shared": F.get(F.filter("_m", lambda f: f["explicit"].isNull() & f["shared"]), F.lit(0))["path"],
            "_paths": F.array_distinct(F.array_compact(F.transform("_m", target))),
            "_unmapped": F.size(F.filter("_m", lambda f: target(f).isNull())),
        }
    )
    s = lambda c: c.cast("string")
    kept, targets = F.size("_m"), F.size("_paths")
    unmatched = F.concat(
        F.lit("No active website is mapped to "), F.coalesce("repository", F.lit("None")), F.lit(" on branch "), F.coalesce("branch", F.lit("None")),
        F.lit(". Connect the repository under the website's integrations to enable re-audits."),
    )
    incremental = F.concat(
        s(targets), F.lit(" page(s) resolved from "), s(kept), F.lit(" changed file(s)."),
        F.when(F.col("_unmapped") > 0, F.concat(F.lit(" "), s(F.col("_unmapped")), F.lit(" file(s) could not be mapped."))).otherwise(F.lit("")),
    )
    ladder = [
        (F.col("event_type") == "ping", "ignored", F.lit("Webhook ping received.")),
        (F.col("event_type") != "push", "ignored", F.concat(F.lit("'"), F.col("event_type"), F.lit("' events are not acted on."))),
        (F.col("site_id").isNull(), "unmatched_repository", unmatched),
        (F.col("deleted"), "ignored", F.lit("Branch deletion, nothing to re-audit.")),
        (~F.col("is_active"), "ignored", F.lit("The website is not active.")),
        (
            F.size("files") == 0,
            "full_crawl",
            F.lit("The push carried no file list (GitHub omits it for very large pushes), so the whole site is re-audited."),
        ),
        (kept == 0, "ignored", F.lit("No changed file can affect rendered output.")),
        (
            F.col("_shared").isNotNull(),
            "full_crawl",
            F.concat(
                F.lit("'"), F.col("_shared"),
                F.lit("' is shared across pages (layout, template, component or config), so its effect cannot be limited to specific URLs."),
            ),
        ),
        (
            targets == 0,
            "full_crawl",
            F.concat(F.lit("None of the "), s(kept), F.lit(" changed files could be mapped to a URL, so the whole site is re-audited to stay correct.")),
        ),
        (
            F.lit(False) if max_targets is None else targets > max_targets,
            "full_crawl",
            F.concat(s(targets), F.lit(f" pages changed, which exceeds the {max_targets}-page incremental limit; a full crawl is cheaper.")),
        ),
        (F.lit(True), "incremental_crawl", incremental),
    ]
    action, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, text in reversed(ladder):
        action = F.when(condition, F.lit(name)).otherwise(action)
        reason = F.when(condition, text).otherwise(reason)
    rows = rows.withColumns({"action": action, "reason": reason})
    base = F.regexp_replace("base_url", "/+$", "")
    urls = F.array_distinct(F.transform("_paths", lambda p: normalize_url(F.concat(base, p))))
    return rows.withColumn("affected_urls", F.when(F.col("action") == "incremental_crawl", urls)).drop(
        "_all", "_m", "_shared", "_paths", "_unmapped", "framework", "path_map", "base_url", "is_active"
    )


def keywords_by_url(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Lower-cased primary and secondary keywords of every page url."""
    none = F.array().cast("array<string>")
    words = F.transform(F.concat(F.coalesce("primary_keywords", none), F.coalesce("secondary_keywords", none)), lambda k: F.lower(k))
    rows = pages.select("page_id", "site_id", "url").join(profiles.select("page_id", words.alias("keywords")), "page_id")
    return rows.filter(F.size("keywords") > 0)


def pr_changes(files: DataFrame, sites: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """One row per detected change of every pull request file, refined by target keywords.

    ``files`` has pr_id, site_id, file_id, filename, patch, additions, deletions.
    """
    rows = files.filter((F.coalesce("patch", F.lit("")) != "") & ~cx.is_ignorable(F.col("filename")))
    found = rows.select(
        "pr_id", "site_id", "file_id", "filename",
        F.posexplode(cx.file_changes(F.col("patch"), F.col("additions"), F.col("deletions"))).alias("pos", "c"),
    )
    # Requests change the same files again and again: a route is resolved once per file of a site.
    names = rows.select("site_id", "filename").distinct().join(sites.select("site_id", "base_url", "framework", "path_map"), "site_id")
    strip = lambda x: F.regexp_replace(x, "^/+|/+$", "")
    none = F.create_map().cast("map<string,string>")
    explicit = F.try_element_at(F.transform_keys(F.coalesce("path_map", none), lambda k, v: strip(k)), strip(F.col("filename")))
    names = names.withColumn("affected_path", F.coalesce(explicit, cx.route_of(F.col("filename"), F.col("framework"))))
    url = normalize_url(F.concat(F.regexp_replace("base_url", "/+$", ""), F.col("affected_path")))
    found = found.join(names.select("site_id", "filename", url.alias("affected_url")), ["site_id", "filename"], "left")
    if keywords is not None:
        side = keywords.select("site_id", F.col("url").alias("affected_url"), "keywords")
        found = found.join(side, ["site_id", "affected_url"], "left").withColumn("c", cx.refine_with_keywords(F.col("c"), F.col("keywords")))
    return found.select("pr_id", "site_id", "file_id", "filename", "affected_url", "pos", "c.*")


def finding_rows(changes: DataFrame) -> DataFrame:
    """Every finding of a pull request as a row, numbered by file and position within its direction."""
    rows = cut(changes.select("pr_id", "direction", "file_id", "pos", "change_type", "description"))  # ranking reads it twice
    return row_numbers(rows, ["pr_id", "direction"], [F.col("file_id").asc(), F.col("pos").asc()], "finding_rank")


def predict(changes: DataFrame, *, listed: int | None = None) -> DataFrame:
    """Expected impact, confidence, risk and suggestions of every pull request.

    All figures are partial sums, so a pull request of very many files is never gathered; :func:`finding_rows` has its findings as rows.
    With ``listed`` the first so many positive and negative findings also come as arrays. Suggestions are at most one per change type,
    in the order in which the types first occur.
    """
    w, negative = F.col("weight"), F.col("direction") == "negative"
    by = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, w)), F.lit(0.0))
    noindex = F.max(negative & (F.col("change_type") == "robots") & F.lower("description").contains("noindex directive was added"))
    rows = changes.groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("change_count"), by("positive").alias("_p"), by("negative").alias("_n"), F.sum(w).alias("_t"), noindex.alias("_noindex"),
        F.count_if(negative).alias("_negatives"),
    )
    p, n, total = rnd("_p", 6), rnd("_n", 6), F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t"))
    impact = (
        F.when((p > 0) & (n == 0), "positive").when((n > 0) & (p == 0), "negative").when((p > 0) & (n > 0), "mixed").otherwise("neutral")
    )
    risk = F.when(F.col("_noindex") | (n >= cx.RISK["critical"]), "critical").when(n >= cx.RISK["high"], "high").when(n >= cx.RISK["medium"], "medium").otherwise("low")
    share = lambda x: rnd(F.least(F.lit(0.95), x / total * 0.9), 2)
    rows = rows.withColumns(
        {"expected_impact": impact, "risk_level": risk, "positive_confidence": share(F.col("_p")), "negative_confidence": share(F.col("_n"))}
    )
    # The advice is a result that must match.
    advice = (
        F.when(F.col("risk_level").isin("critical", "high"), "DO NOT DEPLOY WITHOUT REVISION")
        .when(F.col("risk_level") == "medium", "Review before merging — some findings may reduce SEO performance.")
        .when(F.col("_negatives") == 0, "No blocking SEO concerns detected.")
        .otherwise("Safe to merge; minor findings noted below.")
    )
    remedy = F.create_map(*[F.lit(x) for item in cx.SUGGESTIONS.items() for x in item])
    firsts = changes.filter(negative & F.col("change_type").isin(list(cx.SUGGESTIONS))).groupBy("pr_id", "change_type").agg(F.min(F.struct("file_id", "pos")).alias("_at"))
    remedies = firsts.groupBy("pr_id").agg(F.array_sort(F.collect_list(F.struct("_at", "change_type"))).alias("_remedies"))
    suggested = F.array_distinct(F.transform(F.coalesce("_remedies", F.array().cast("array<struct<_at:struct<file_id:long,pos:int>,change_type:string>>")), lambda x: F.try_element_at(remedy, x["change_type"])))
    out = rows.join(remedies, "pr_id", "left").select(
        "pr_id", "change_count", "expected_impact", "positive_confidence", "negative_confidence", "risk_level", advice.alias("recommendation"), suggested.alias("suggested_changes"),
    )
    if listed is None:
        return out
    first = top_per_key(changes, ["pr_id", "direction"], [F.col("file_id").asc(), F.col("pos").asc()], listed, "_k")
    texts = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("_k", "description")))), lambda x: x["description"]).alias(f"{d}_findings")
    lists = first.groupBy("pr_id").agg(texts("positive"), texts("negative"))
    return out.join(lists, "pr_id", "left")


def latest_analysis(pull_requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every pull request with its newest analysis, if any."""
    newest = newest_per_key(analyses, ["pr_id"], ["analysis_id"])
    return pull_requests.join(newest, "pr_id", "left")


def events_of_pages(pages: DataFrame, events: DataFrame, k: int = 5) -> DataFrame:
    """The newest ``k`` events that affect each page: events naming its URL, and site-wide ones.

    Site-wide events are cut to the newest ``k`` per site before they meet the pages, which cannot
    change the result: no page shows more than ``k``.
    """
    newest = [F.col("event_id").desc()]
    named = events.filter("affected_urls is not null").select("site_id", "event_id", F.explode(F.array_distinct("affected_urls")).alias("url"))
    own = pages.select("site_id", "page_id", "url").join(named, ["site_id", "url"]).select("page_id", "event_id")
    general = top_per_key(events.filter("affected_urls is null").select("site_id", "event_id"), ["site_id"], newest, k)
    shared = pages.select("site_id", "page_id").join(general, "site_id").select("page_id", "event_id")
    return top_per_key(own.unionByName(shared), ["page_id"], newest, k, "event_rank")
