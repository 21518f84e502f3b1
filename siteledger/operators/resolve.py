"""Provider rows to pages: exact URL, then path, then path under the site root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, provider_path, url_path
from .ranking import top_per_key


def page_index(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookup frames (site, url hash) -> page and (site, path) -> first page by id."""
    by_hash = (
        pages.select("site_id", F.sha2(normalize_url("url"), 256).alias("url_hash"), "page_id")
        .groupBy("site_id", "url_hash")
        .agg(F.min("page_id").alias("page_id"))
    )
    paths = pages.select(
        "site_id",
        "page_id",
        F.explode(F.array_distinct(F.array(provider_path("path"), provider_path(url_path("url"))))).alias("norm_path"),
    )
    by_path = paths.groupBy("site_id", "norm_path").agg(F.min("page_id").alias("page_id"))
    return by_hash, by_path


def resolve_pages(keys: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Map distinct (site_id, raw_url) to ``page_id`` and the level that matched, null if none.

    Only distinct raw keys take part in the joins; fact rows join the small result afterwards.
    """
    by_hash, by_path = page_index(pages)
    trimmed = F.trim("raw_url")
    absolute = trimmed.rlike("^https?://")
    candidate = (
        F.when(absolute, url_path(trimmed)).when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit("/"), trimmed))
    )
    distinct = (
        keys.select("site_id", "raw_url")
        .distinct()
        .join(sites.select("site_id", F.regexp_replace("base_url", "/+$", "").alias("_base")), "site_id", "left")
        .withColumns(
            {
                "_h1": F.when(absolute, F.sha2(normalize_url(trimmed), 256)),
                "_path": F.when(trimmed != "", provider_path(candidate)),
                "_h2": F.when(trimmed != "", F.sha2(normalize_url(F.concat(F.col("_base"), candidate)), 256)),
            }
        )
    )

    def level(frame: DataFrame, index: DataFrame, key: str, index_key: str, name: str) -> DataFrame:
        side = index.select("site_id", F.col(index_key).alias(key), F.col("page_id").alias(name))
        return frame.join(side, ["site_id", key], "left")

    out = level(distinct, by_hash, "_h1", "url_hash", "_p1")
    out = level(out, by_path, "_path", "norm_path", "_p2")
    out = level(out, by_hash, "_h2", "url_hash", "_p3")
    return out.select(
        "site_id",
        "raw_url",
        F.coalesce("_p1", "_p2", "_p3").alias("page_id"),
        F.when(F.col("_p1").isNotNull(), "url")
        .when(F.col("_p2").isNotNull(), "path")
        .when(F.col("_p3").isNotNull(), "base_path")
        .alias("matched_by"),
    )


def match_report(rows: DataFrame, resolved: DataFrame, samples: int = 10) -> DataFrame:
    """Per site: matched and unmatched provider rows, and up to ten unmatched raw values."""
    counts_per_key = rows.groupBy("site_id", "raw_url").agg(F.count(F.lit(1)).alias("n"))
    joined = counts_per_key.join(resolved, ["site_id", "raw_url"], "left")
    totals = joined.groupBy("site_id").agg(
        F.coalesce(F.sum(F.when(F.col("page_id").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("n"))), F.lit(0)).alias("unmatched"),
    )
    examples = (
        top_per_key(joined.filter("page_id is null"), ["site_id"], [F.col("raw_url").asc()], samples)
        .groupBy("site_id")
        .agg(F.array_sort(F.collect_list("raw_url")).alias("unmatched_samples"))
    )
    return totals.join(examples, "site_id", "left")
