"""Robots directives of the meta tag and the X-Robots-Tag header as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directives with a value, bare directives, agents whose groups apply.
VALUED = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]
BARE = [
    "all", "index", "noindex", "follow", "nofollow", "none", "noarchive", "nosnippet", "noimageindex", "notranslate",
    "nositelinkssearchbox", "indexifembedded",
]
AGENTS = ("*", "robots", "googlebot", "googlebot-news", "google")


def parse(value: Column | str) -> Column:
    """Struct(directives, values, ignored_agents) of one tag or header; lines may name an agent."""
    text = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def scoped(line: Column) -> Column:
        head = F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1)))
        is_agent = line.contains(":") & (head != "") & ~head.contains(" ") & ~head.isin(*VALUED, *BARE)
        payload = F.when(is_agent, F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)).otherwise(line)
        return F.struct(F.when(is_agent, head).alias("agent"), payload.alias("payload"))

    groups = F.transform(lines, scoped)
    ignored = F.filter(groups, lambda g: g["agent"].isNotNull() & ~g["agent"].isin(*AGENTS))
    bound = F.filter(groups, lambda g: g["agent"].isNull() | g["agent"].isin(*AGENTS))
    tokens = F.filter(
        F.transform(F.flatten(F.transform(bound, lambda g: F.split(g["payload"], ","))), lambda x: F.trim(x)), lambda t: t != ""
    )
    key = lambda t: F.lower(F.trim(F.regexp_extract(t, r"^([^:]*):", 1)))
    valued = F.filter(tokens, lambda t: key(t).isin(*VALUED))
    bare = F.array_distinct(F.transform(F.filter(tokens, lambda t: ~key(t).isin(*VALUED)), F.lower))
    return F.struct(
        bare.alias("directives"),
        F.transform(valued, lambda t: F.concat(key(t), F.lit(":"), F.trim(F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)))).alias("values"),
        F.transform(ignored, lambda g: g["agent"]).alias("ignored_agents"),
    )


def merge(meta: Column, header: Column) -> Column:
    """Union of both sources: the most restrictive outcome applies. Inputs are parsed structs."""
    return F.struct(
        F.array_sort(F.array_union(meta["directives"], header["directives"])).alias("directives"),
        F.array_sort(F.array_union(meta["values"], header["values"])).alias("values"),
        F.concat(meta["ignored_agents"], header["ignored_agents"]).alias("ignored_agents"),
        header["directives"].alias("header_directives"),
    )


def resolve(meta: Column | str, header: Column | str) -> Column:
    return merge(parse(meta), parse(header))


def noindex(directives: Column) -> Column:
    return F.arrays_overlap(directives, F.array(F.lit("noindex"), F.lit("none")))


def nofollow(directives: Column) -> Column:
    return F.arrays_overlap(directives, F.array(F.lit("nofollow"), F.lit("none")))
