"""A second measurement of the same markup: regular expressions alone, sharing nothing with the tokenising extraction.

It stays inside the JVM and serves to check :mod:`siteledger.sources.html`, metric by metric (``plans.audit.agreement``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = (
    "status_code", "title", "title_count", "meta_description_present", "meta_description_count", "canonical_count", "canonical_href", "h1_count", "h1_text",
    "h2_count", "h3_count", "img_count", "img_missing_alt", "img_empty_alt", "internal_links", "external_links", "nofollow_links", "meta_robots", "lang",
    "hreflang_count", "json_ld", "microdata", "word_count",
)
# Metrics that count other things by design: main content against the whole body, images without tracking pixels, links by
# distinct target against anchors.
EXPECTED = ("word_count", "img_count", "internal_links", "external_links")

_UNSEEN = r"(?is)<!--.*?-->|<(script|style|template|noscript|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)"
# Old names also stand without their semicolon: anywhere in text, in an attribute only where no name or value goes on.
_NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"))
_STRICT = (("&#39(?:;|(?![0-9]))", "'"), ("&apos;", "'"))


def _plain(text: Column, *, attribute: bool = False) -> Column:
    open_end = "(?:;|(?![=A-Za-z0-9]))" if attribute else ";?"
    for mark, value in (*((f"&{name}{open_end}", value) for name, value in _NAMED), *_STRICT, (f"&amp{open_end}", "&")):
        text = F.regexp_replace(text, mark, value)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _text(markup: Column) -> Column:
    return _plain(F.regexp_replace(markup, r"(?s)<[^>]*>", " "))


def _tags(markup: Column, name: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>"), 0)


def _has(tag: Column, name: str) -> Column:
    return F.regexp_like(tag, F.lit(rf"(?is)\s{name}(?:\s*=|[\s/>])"))


def _value(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or bare; empty without one."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.trim(_plain(F.regexp_replace(found, "^[\"']|[\"']$", ""), attribute=True))


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def _host(url: Column) -> Column:
    host = F.when(url.startswith("//"), F.regexp_extract(url, r"^//([^/?#]*)", 1)).otherwise(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.lower(F.substring_index(host, ":", 1)), r"^www\.", "")


def markup_signals(documents: DataFrame) -> DataFrame:
    """``METRICS`` of every document (page_id, html, base_domain, optionally status_code); absent texts are null."""
    rows = documents if "status_code" in documents.columns else documents.withColumn("status_code", F.lit(200))
    rows = rows.withColumn("_seen", F.regexp_replace(F.coalesce("html", F.lit("")), _UNSEEN, " "))
    seen, html = F.col("_seen"), F.coalesce("html", F.lit(""))
    named = lambda wanted: lambda tag: F.lower(_value(tag, "name")) == wanted
    rel = lambda wanted: lambda tag: F.array_contains(F.split(F.lower(_value(tag, "rel")), r"\s+"), wanted)
    rows = rows.withColumns(
        {
            "_titles": F.regexp_extract_all(seen, F.lit(r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"), 1),
            "_desc": F.filter(_tags(seen, "meta"), named("description")),
            "_robots": F.filter(_tags(seen, "meta"), named("robots")),
            "_canon": F.filter(_tags(seen, "link"), rel("canonical")),
            "_alter": F.filter(_tags(seen, "link"), lambda t: rel("alternate")(t) & (_value(t, "hreflang") != "")),
            "_h1": F.regexp_extract_all(seen, F.lit(r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>"), 1),
            "_imgs": _tags(seen, "img"),
            "_links": F.filter(_tags(seen, "a"), lambda t: (_value(t, "href") != "") & ~F.regexp_like(_value(t, "href"), F.lit(r"^(#|mailto:|tel:|javascript:|data:)"))),
            "_html": _first(_tags(seen, "html")),
            "_body": F.when(F.regexp_like(seen, F.lit(r"(?is)<body(?:\s[^>]*)?>")), F.regexp_extract(seen, r"(?is)<body(?:\s[^>]*)?>(.*)$", 1)).otherwise(seen),
        }
    )
    own = F.regexp_replace(F.lower("base_domain"), r"^www\.", "")
    local = lambda t: (_host(_value(t, "href")) == "") | (_host(_value(t, "href")) == own)
    count = lambda xs: F.size(xs).cast("int")
    words = _text(F.col("_body"))
    lone = lambda text: F.nullif(text, F.lit(""))
    return rows.select(
        "page_id",
        F.col("status_code").cast("int").alias("status_code"),
        lone(_text(_first(F.col("_titles")))).alias("title"),
        count("_titles").alias("title_count"),
        F.coalesce(_value(_first(F.col("_desc")), "content") != "", F.lit(False)).alias("meta_description_present"),
        count("_desc").alias("meta_description_count"),
        count("_canon").alias("canonical_count"),
        lone(_value(_first(F.col("_canon")), "href")).alias("canonical_href"),
        count("_h1").alias("h1_count"),
        lone(F.array_join(F.filter(F.transform("_h1", _text), lambda t: t != ""), " | ")).alias("h1_text"),
        count(_tags(seen, "h2")).alias("h2_count"),
        count(_tags(seen, "h3")).alias("h3_count"),
        count("_imgs").alias("img_count"),
        count(F.filter("_imgs", lambda t: ~_has(t, "alt"))).alias("img_missing_alt"),
        count(F.filter("_imgs", lambda t: _has(t, "alt") & (_value(t, "alt") == ""))).alias("img_empty_alt"),
        count(F.filter("_links", local)).alias("internal_links"),
        count(F.filter("_links", lambda t: ~local(t))).alias("external_links"),
        count(F.filter("_links", rel("nofollow"))).alias("nofollow_links"),
        lone(_value(_first(F.col("_robots")), "content")).alias("meta_robots"),
        lone(_value(F.col("_html"), "lang")).alias("lang"),
        count("_alter").alias("hreflang_count"),
        F.regexp_like(html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']?[^\"'>]*ld\+json")).alias("json_ld"),
        F.regexp_like(seen, F.lit(r"(?is)<[a-z][^>]*\sitemtype\s*=")).alias("microdata"),
        F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).alias("word_count"),
    )


def extracted_signals(pages: DataFrame) -> DataFrame:
    """The same metrics, read off the output of the extraction."""
    formats = F.coalesce("structured_data_formats", F.array().cast("array<string>"))
    return pages.select(
        "page_id", F.col("status_code").cast("int").alias("status_code"), "title", "title_count",
        (F.coalesce("meta_description", F.lit("")) != "").alias("meta_description_present"), "meta_description_count", "canonical_count",
        F.col("canonical_raw").alias("canonical_href"), "h1_count", F.col("h1").alias("h1_text"), "h2_count", "h3_count", F.col("image_count").alias("img_count"),
        F.col("missing_alt_count").alias("img_missing_alt"), F.col("empty_alt_count").alias("img_empty_alt"), F.col("internal_link_count").alias("internal_links"),
        F.col("external_link_count").alias("external_links"), F.col("nofollow_link_count").alias("nofollow_links"), "meta_robots", "lang",
        F.size("hreflang").alias("hreflang_count"), F.array_contains(formats, "json-ld").alias("json_ld"), F.array_contains(formats, "microdata").alias("microdata"),
        "word_count",
    )
