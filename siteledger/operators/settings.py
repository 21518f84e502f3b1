"""Configuration overlay: defaults, then the global row, then the site row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(
    sites: DataFrame,
    settings: DataFrame,
    key: str,
    defaults: dict[str, float],
    *,
    floor_zero: bool = True,
) -> DataFrame:
    """Per site, one column per component of ``defaults``.

    ``settings`` is (site_id, key, value map<string,string>), site_id null for the global row.
    Non-numeric entries are ignored, negatives become zero. The rows for one key are aggregated to
    one per scope, so the joins stay one to one.
    """
    rows = settings.filter(F.col("key") == key)

    def scope(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        picks = [F.max(F.col("value")[c].try_cast("double")).alias(f"{prefix}{c}") for c in defaults]
        return df.groupBy(*keys).agg(*picks)

    site_rows = scope(rows.filter("site_id is not null"), "_s_", ["site_id"])
    global_row = scope(rows.filter("site_id is null").withColumn("_one", F.lit(1)), "_g_", ["_one"])
    out = (
        sites.select("site_id")
        .distinct()
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(global_row), "_one", "left")  # one row by construction
        .join(site_rows, "site_id", "left")
    )

    def pick(c: str, default: float) -> Column:
        value = F.coalesce(F.col(f"_s_{c}"), F.col(f"_g_{c}"), F.lit(float(default)))
        return F.greatest(F.lit(0.0), value) if floor_zero else value

    return out.select("site_id", *[pick(c, d).alias(c) for c, d in defaults.items()])
