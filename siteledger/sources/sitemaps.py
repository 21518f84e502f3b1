"""Sitemap documents to URL entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_probably_page, normalize_url, registrable_domain
from ..operators.ranking import first_per_key, top_per_key
from ..session import cut

COMPACT = 16  # levels of a walk after which what was reached is one table again
_LOC = r"(?is)<(?:\w+:)?loc[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"


def _blocks(body: Column, tag: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), 1)


def _unescape(text: Column) -> Column:
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _field(block: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?is)<(?:\w+:)?{tag}[^>]*>\s*(.*?)\s*</(?:\w+:)?{tag}>", 1)), F.lit(""))


def _loc(block: Column) -> Column:
    return F.nullif(_unescape(F.trim(F.regexp_extract(block, _LOC, 1))), F.lit(""))


def parse_documents(docs: DataFrame, body: str = "body") -> DataFrame:
    """Add ``entries`` (loc, lastmod, changefreq, priority), ``nested`` and ``used_fallback``.

    Broken XML without a complete entry keeps every ``<loc>`` that can still be read.
    """
    b = F.col(body)
    entry = lambda x: F.struct(
        _loc(x).alias("loc"), _field(x, "lastmod").alias("lastmod"), F.lower(_field(x, "changefreq")).alias("changefreq"),
        _field(x, "priority").try_cast("double").alias("priority"),
    )
    named = lambda xs: F.filter(xs, lambda e: e["loc"].isNotNull())
    out = docs.withColumns(
        {
            "_e": named(F.transform(_blocks(b, "url"), entry)),
            "_n": F.filter(F.transform(_blocks(b, "sitemap"), _loc), lambda u: u.isNotNull()),
            "_all": F.filter(F.transform(F.regexp_extract_all(b, F.lit(_LOC), 1), lambda u: _unescape(F.trim(u))), lambda u: u != ""),
        }
    )
    broken = (F.size("_e") == 0) & (F.size("_n") == 0) & (F.size("_all") > 0)
    bare = lambda u: F.struct(u.alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit(None).cast("string").alias("changefreq"), F.lit(None).cast("double").alias("priority"))
    return out.withColumns(
        {"entries": F.when(broken, F.transform("_all", bare)).otherwise(F.col("_e")), "nested": F.col("_n"), "used_fallback": broken}
    ).drop("_e", "_n", "_all", body)


def walk(docs: DataFrame, seeds: DataFrame, *, max_depth: int | None = None, max_children: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, dropped): what can be reached from the seed sitemaps, each once, with the depth it was reached at.

    ``docs`` is the parsed table (site_id, sitemap_url, ...), ``seeds`` (site_id, sitemap_url). Documents are parsed once; the walk runs
    over the narrow edges (parent, child) and goes on until no new document is found. Limits are off unless given; every child
    that a limit leaves out is a row of ``dropped`` with the reason, ``too_deep`` or ``too_many``.
    """
    keys = ["site_id", "sitemap_url"]
    # A level may be as large as the table, and there are many: a hint keeps each of them from being sent through the driver to every task.
    merged = lambda df: df.hint("merge")
    parsed = cut(docs)
    known = cut(parsed.select(*keys).distinct())
    edges = cut(parsed.select(*keys, F.posexplode("nested").alias("pos", "child")))
    reached = dropped = None
    frontier, depth = seeds.select(*keys).distinct().join(merged(known), keys, "left_semi"), 0
    while True:
        frontier = cut(frontier.withColumn("depth", F.lit(depth)))
        if reached is not None and frontier.isEmpty():
            break
        reached = frontier if reached is None else reached.union(frontier)
        if depth % COMPACT == COMPACT - 1:
            reached = cut(reached)
        reason = F.lit(None).cast("string")
        if max_children is not None:
            reason = F.when(F.col("pos") >= max_children, "too_many")
        if max_depth is not None and depth >= max_depth:
            reason = F.lit("too_deep")
        children = edges.join(merged(frontier.select(*keys)), keys).select("site_id", F.col("child").alias("sitemap_url"), reason.alias("reason"))
        over = children.filter("reason is not null")
        dropped = over if dropped is None else dropped.union(over)
        frontier = children.filter("reason is null").select(*keys).distinct().join(merged(known), keys, "left_semi").join(merged(reached.select(*keys)), keys, "left_anti")
        depth += 1
    return parsed.join(merged(reached), keys), dropped


def url_entries(documents: DataFrame, sites: DataFrame, dropped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, skips): admitted URLs with their metadata, and skipped entries counted by reason.

    ``dropped`` are the children that a limited walk left out; they count as skips too.
    """
    rows = documents.select("site_id", "sitemap_url", "depth", F.posexplode("entries").alias("pos", "e")).select(
        "site_id", "sitemap_url", "depth", "pos", "e.*", normalize_url("e.loc").alias("url")
    )
    rows = rows.join(sites.select("site_id", "base_domain"), "site_id")
    fault = F.when(registrable_domain("url") != registrable_domain("base_domain"), "off_domain").when(~is_probably_page("url"), "asset")
    rows = rows.withColumn("reason", fault)
    good = rows.filter("reason is null")
    order = [F.col("depth").asc(), F.col("sitemap_url").asc(), F.col("pos").asc()]
    entries = first_per_key(good, ["site_id", "url"], order).drop("reason", "base_domain")
    repeats = good.groupBy("site_id", "url").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    skipped = (
        rows.filter("reason is not null").groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(repeats.groupBy("site_id").agg(F.sum("n").alias("n")).select("site_id", F.lit("duplicate").alias("reason"), "n"))
    )
    if dropped is not None:
        skipped = skipped.unionByName(dropped.groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("n")))
    return entries, skipped
