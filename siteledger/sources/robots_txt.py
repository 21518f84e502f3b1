"""robots.txt corpus to rules, and the longest-match test as a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import _decode, _part, raw_path
from ..operators.joins import HEAVY_ROWS, heavy_join
from ..session import cut


def _lines(docs: DataFrame) -> DataFrame:
    """(origin, pos, directive, value) of every meaningful line."""
    rows = docs.select("origin", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "raw"))
    line = F.trim(F.substring_index("raw", "#", 1))
    rows = rows.withColumn("line", line).filter(F.contains("line", F.lit(":")))
    return rows.select(
        "origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("directive"), F.trim(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1)).alias("value")
    )


def sitemap_lines(docs: DataFrame) -> DataFrame:
    return _lines(docs).filter("directive = 'sitemap' and value <> ''").select("origin", F.col("value").alias("sitemap_url"))


def robots_rules(docs: DataFrame, user_agent: str = "*") -> DataFrame:
    """(origin, kind, value) rules that bind ``user_agent``: its own block beats the wildcard block.

    Consecutive agent lines share one block. Windows run inside one document.
    """
    token = user_agent.split("/")[0].strip().lower()
    rows = _lines(docs).filter("directive <> 'sitemap'")
    order = Window.partitionBy("origin").orderBy("pos")
    is_agent = F.col("directive") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(order)).filter("block > 0")
    agents = rows.filter(is_agent).select("origin", "block", "pos", F.lower("value").alias("agent"))
    ours = (F.col("agent") != "") & (F.col("agent") != "*") & F.contains(F.lit(token), F.col("agent"))
    choice = F.struct(F.when(ours, 0).otherwise(1).alias("o"), "pos")
    chosen = agents.filter(ours | (F.col("agent") == "*")).groupBy("origin").agg(F.min_by("agent", choice).alias("agent"))
    blocks = agents.join(chosen, ["origin", "agent"]).select("origin", "block").distinct()
    rules = rows.filter(F.col("directive").isin("allow", "disallow", "crawl-delay")).join(blocks, ["origin", "block"])
    keep = (F.col("directive") == "allow") | ((F.col("directive") == "disallow") & (F.col("value") != ""))
    delay = (F.col("directive") == "crawl-delay") & F.col("value").try_cast("double").isNotNull()
    return rules.filter(keep | delay).select("origin", F.col("directive").alias("kind"), "value", "pos")


def _pattern(value: Column) -> Column:
    """Regular expression of a rule path: ``*`` matches anything, a final ``$`` anchors."""
    anchored = value.endswith("$")
    body = F.when(anchored, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    quoted = F.concat(F.lit("^\\Q"), F.replace(body, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.concat(quoted, F.when(anchored, "$").otherwise(""))


def rule_index(rules: DataFrame) -> DataFrame:
    """(origin, prefix, kind, size, pattern): every path rule under the text before its first ``*`` or final ``$``.

    ``pattern`` is null where the prefix alone decides.
    """
    value = F.col("value")
    anchored = value.endswith("$")
    body = F.when(anchored, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return rules.filter("kind in ('allow', 'disallow') and value <> ''").select(
        "origin", F.substring_index(body, "*", 1).alias("prefix"), "kind", F.length(value).alias("size"),
        F.when(anchored | F.contains(value, F.lit("*")), _pattern(value)).alias("pattern"),
    ).distinct()


def path_of(url: Column) -> Column:
    """Decoded path and query of a URL, as rules see it."""
    path = F.when(raw_path(url) == "", F.lit("/")).otherwise(_decode(raw_path(url)))
    query = _part(url, 4)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def allow_urls(urls: DataFrame, rules: DataFrame, *, limit: int = HEAVY_ROWS) -> DataFrame:
    """The URLs with ``allowed``: the longest matching rule of the origin wins, ties allow; no rule allows everything.

    A URL is looked up by its beginnings, of the lengths that rules of its origin have, so it meets only rules whose text it starts
    with, and wildcards are tried on those alone. An origin or a beginning that more than ``limit`` URLs share is joined in parts.
    """
    origin = F.lower(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    index = cut(rule_index(rules))
    lengths = index.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as paths have lengths
    found = cut(urls.select("url").distinct().select("url", origin.alias("origin"), path_of(F.col("url")).alias("path")))
    probes = heavy_join(found, lengths, ["origin"], limit=limit, spread=["url"])
    probes = probes.select("url", "path", "origin", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    probes = probes.withColumn("prefix", F.substring("path", F.lit(1), F.col("n")))
    hits = heavy_join(probes, index, ["origin", "prefix"], limit=limit, spread=["url"]).filter(F.col("pattern").isNull() | F.regexp_like("path", F.col("pattern")))
    longest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("size")))
    verdict = hits.groupBy("url").agg(longest("allow").alias("_allow"), longest("disallow").alias("_disallow"))
    allowed = F.col("_disallow").isNull() | (F.coalesce("_allow", F.lit(-1)) >= F.col("_disallow"))
    return urls.join(verdict, "url", "left").withColumn("allowed", allowed).drop("_allow", "_disallow")
