"""One discovery step over a crawled corpus: candidate URLs, admission and rejects by reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_probably_page, matches_any, normalize_url, registrable_domain
from ..sources.html import discovered_urls
from ..sources.robots_txt import allow_urls


def admission(urls: DataFrame, rules: DataFrame | None = None, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Add ``rejected_by``: null for admitted URLs, else the first test that failed.

    ``urls`` has url and base_domain.
    """
    u = F.col("url")
    tests = [(~is_probably_page(u), "not_a_page")]
    if exclude:
        tests.append((matches_any(u, exclude), "excluded"))
    if include:
        tests.append((~matches_any(u, include), "not_included"))
    fault = F.lit(None).cast("string")
    for failed, name in reversed(tests):
        fault = F.when(failed, F.lit(name)).otherwise(fault)
    off_domain = F.when(registrable_domain(u) != registrable_domain("base_domain"), "off_domain")
    if rules is None:
        return urls.withColumn("rejected_by", F.coalesce(off_domain, fault))
    # Rows meet the verdict of robots.txt by URL, so what the text of a URL decides is worked out once a URL too.
    faults = urls.select("url").distinct().withColumn("_fault", fault)
    rows = allow_urls(urls, rules).join(faults, "url", "left")
    return rows.withColumn("rejected_by", F.coalesce(off_domain, "_fault", F.when(~F.col("allowed"), "robots"))).drop("allowed", "_fault")


def reject_counts(admitted: DataFrame) -> DataFrame:
    return admitted.filter("rejected_by is not null").groupBy("rejected_by").agg(F.count(F.lit(1)).alias("n"))


def discover(pages: DataFrame, known: DataFrame, rules: DataFrame | None = None, **patterns) -> DataFrame:
    """URLs the corpus points to that are not known yet and pass admission."""
    found = discovered_urls(pages).join(known.select(normalize_url("url").alias("url")), "url", "left_anti")
    return admission(found, rules, **patterns).filter("rejected_by is null").drop("rejected_by")
