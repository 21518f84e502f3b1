"""Model prompt text of selected pages, assembled from joined frames (the model call is not made here)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import num, rnd
from ..operators.ranking import top_per_key


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default))


def _count(c: str) -> Column:
    return F.format_number(num(c).cast("long"), 0)


def _lines(rows: DataFrame, keys: str, rank: str, text: Column, name: str, listed: int | None) -> DataFrame:
    """The lines of a page in rank order, all or the first ``listed``."""
    rows = rows.withColumn("_t", text)
    best = rows.withColumn("_r", F.col(rank)) if listed is None else top_per_key(rows, [keys], [F.col(rank).asc()], listed, "_r")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"])
    return best.groupBy(keys).agg(F.array_join(ordered, "\n").alias(name))


# Headings and lines of the prompt are results that must match.
def metrics_text(window_days: int) -> Column:
    has = lambda *cs: sum((num(c) for c in cs), F.lit(0.0)) > 0
    cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    activity = cat(
        "  Analytics: ", _count("users"), " users, ", _count("sessions"), " sessions, ", F.format_number(F.bround(num("conversions"), 0), 0), " conversions, ",
        F.format_number(rnd(num("revenue"), 2), 2), " revenue",
    )
    engagement = cat("  Engagement rate: ", F.format_string("%.1f", rnd(F.col("engagement_rate") * 100.0, 1)), "%")
    search = cat(
        "  Search Console: ", _count("clicks"), " clicks, ", _count("impressions"), " impressions",
        F.when(F.col("ctr").isNotNull(), cat(", CTR ", F.format_string("%.2f", rnd(F.col("ctr") * 100.0, 2)), "%")).otherwise(""),
        F.when(F.col("position").isNotNull(), cat(", average position ", F.col("position").cast("string"))).otherwise(""),
    )
    keywords = cat(
        "  Semrush: ", F.col("organic_keywords").cast("string"), " ranking keywords, ", num("striking_distance_keywords").cast("long").cast("string"),
        " in striking distance (positions 4-20), ", num("backlinks").cast("long").cast("string"), " backlinks",
    )
    body = F.concat_ws(
        "\n",
        F.lit(f"Performance over the last {window_days} days:"),
        F.when(has("users", "sessions"), activity),
        F.when(has("users", "sessions") & F.col("engagement_rate").isNotNull(), engagement),
        F.when(has("clicks", "impressions"), search),
        F.when(num("organic_keywords") > 0, keywords),
    )
    return F.when(has("users", "clicks", "impressions"), body).otherwise(F.lit("No analytics or Search Console data is available for this page."))


def build_prompts(
    pages: DataFrame, issues: DataFrame, queries: DataFrame, keywords: DataFrame, *, window_days: int = 90, max_content: int | None = None,
    listed: int | None = None, max_evidence: int | None = None,
) -> DataFrame:
    """(page_id, prompt). ``pages`` carries signals, scores and window metrics.

    The whole page text, all queries and keywords and whole evidence go in; ``max_content``, ``listed`` and ``max_evidence`` limit
    them for a model whose input is limited.
    """
    cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    quoted = lambda c: cat('  "', F.col(c), '" — ')
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    query_lines = _lines(
        queries, "page_id", "query_rank", cat(quoted("query"), number("clicks"), " clicks, ", number("impressions"), " impressions, position ", number("position")), "_queries", listed
    )
    keyword_lines = _lines(
        keywords, "page_id", "idx", cat(quoted("keyword"), "position ", number("position"), ", volume ", _count("volume"), ", difficulty ", number("difficulty")), "_keywords", listed
    )
    whole = F.to_json("evidence") if "evidence" in issues.columns else F.lit("")
    shown = whole if max_evidence is None else F.substring(whole, 1, max_evidence)
    evidence = F.when(F.col("evidence").isNotNull(), cat("\n      evidence: ", shown)).otherwise("") if "evidence" in issues.columns else F.lit("")
    finding = cat("  [", F.col("severity"), "] ", F.col("rule_id"), ": ", F.col("description"), evidence)
    # One line per open rule of a page: bounded by the rule registry.
    open_rows = issues.filter("not is_resolved").withColumn("_t", finding)
    found = open_rows.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("issue_id", "_t"))), lambda x: x["_t"]), "\n").alias("_issues")
    )
    rows = pages.join(found, "page_id", "left").join(query_lines, "page_id", "left").join(keyword_lines, "page_id", "left")
    content = F.coalesce("content", F.lit(""))
    content = content if max_content is None else F.substring(content, 1, max_content)
    types = F.coalesce(F.nullif(F.array_join("structured_data_types", ", "), F.lit("")), F.lit("none"))
    count = lambda c: num(c).cast("long").cast("string")
    section = lambda title, c: F.when(F.col(c).isNotNull(), cat("\n\n", title, "\n", F.col(c))).otherwise("")
    issues_text = F.when(
        F.col("_issues").isNotNull(), cat("Deterministic rule-engine findings (these are established facts):\n", F.col("_issues"))
    ).otherwise("The rule engine found no issues on this page.")
    prompt = cat(
        "URL: ", F.col("url"), "\nHTTP status: ", _or("status_code", "unknown"), "\n\nCurrent on-page values:",
        "\n  Title: ", _or("title", "(missing)"), "\n  Meta description: ", _or("meta_description", "(missing)"), "\n  H1: ", _or("h1", "(missing)"),
        "\n  H2 count: ", count("h2_count"), "   H3 count: ", count("h3_count"), "\n  Canonical: ", _or("canonical_url", "(none)"),
        "\n  Robots: ", _or("meta_robots", "(none)"), "\n  Language: ", _or("lang", "(not declared)"), "\n  Word count: ", count("word_count"),
        "\n  Images: ", count("image_count"), " (", count("missing_alt_count"), " without alt text)",
        "\n  Internal links out: ", count("internal_link_count"), "   in: ", count("inbound_internal_links"), "\n  Structured data: ", types,
        "\n\nSEO health score: ", _or("seo_score", "n/a"), "/100 (", _or("seo_category", "n/a"), ", worst severity ", _or("highest_severity", "n/a"), ")",
        F.when(F.col("priority_score").isNotNull(), cat("\nBusiness priority score: ", F.col("priority_score").cast("string"), "/100 (band ", _or("priority_band", "n/a"), ")")).otherwise(""),
        "\n\n", issues_text, "\n\n", metrics_text(window_days),
        section("Top search queries already reaching this page:", "_queries"), section("Keywords this page ranks for (Semrush):", "_keywords"),
        "\n\nPage text content:\n", F.when(content == "", "(no readable text was extracted)").otherwise(content),
    )
    return rows.select("page_id", prompt.alias("prompt"))
