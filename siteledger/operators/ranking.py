"""Exact ranks inside groups that may hold most of the table.

A plain ``row_number().over(partitionBy(site))`` sorts a whole site in one task. Here rows are range-partitioned by group and
order, so a large group spans many tasks in order. The rows of a group before a task follow from one count per (group, task), and
a window inside (group, task) gives the rest. Nothing is assumed of ids, values or how many of them are distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import HEAVY_ROWS, NONE_HEAVY, heavy_join

PART = "_part"


def in_order(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with ``_part``, the number of their range partition by group and order; materialised, so that the numbers stay."""
    return cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn(PART, F.spark_partition_id()))


def with_running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, *, weight: str | None = None, total: str | None = None, keep_part: bool = False
) -> DataFrame:
    """Add ``name``: the weights (default 1) of the rows of the group before a row in the order; ``total``: those of the whole group.

    ``order`` should be unique in a group: rows that are equal in it count in any order, and fall into one range partition.
    """
    group = list(group)
    value = F.lit(1) if weight is None else F.col(weight)
    rows = in_order(df, group, order)
    whole = Window.partitionBy(*group)
    until = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy(*group, PART).agg(F.sum(value).alias("_n"))
    parts = parts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(PART).alias("_p"),
        (F.sum("_n").over(until) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(PART) == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.equal_null(F.col(g), F.col(f"_g{i}"))
    out = counted.join(parts, same).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_p", "_before", "_total", "_inside", *[f"_g{i}" for i in range(len(group))], *([] if keep_part else [PART]))


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, *, total: str | None = None, keep_part: bool = False) -> DataFrame:
    """Add a 1-based position in the order of the group; end ``order`` with a unique column."""
    return with_running_total(df, group, order, name, total=total, keep_part=keep_part).withColumn(name, F.col(name) + 1)


def value_ranks(df: DataFrame, group: Sequence[str], value: str, *, descending: bool = False) -> DataFrame:
    """One row per (group, value): rows before it in the order, rows equal to it, rows in the group."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("rows_equal"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    out = with_running_total(counts, group, [order], "rows_before", weight="rows_equal", total="rows_total")
    return out.select(*group, value, "rows_before", "rows_equal", "rows_total")


def percent_ranks(df: DataFrame, group: Sequence[str], values: dict[str, str], *, limit: int = HEAVY_ROWS) -> DataFrame:
    """Add ``values[v]`` = percent rank of column ``v`` inside its group, for every v.

    Ties share the rank of their first row; a constant or single-row group ranks 0. A value that many rows share (often 0) is
    joined in parts of ``limit`` rows.
    """
    group = list(group)
    measured = F.array(*[F.struct(F.lit(v).alias("_measure"), F.col(v).cast("double").alias("_value")) for v in values])
    long = df.select(*group, F.explode(measured).alias("_m")).select(*group, "_m.*")
    ranks = cut(value_ranks(long, [*group, "_measure"], "_value"))  # all measures at once
    frequent = not ranks.filter(F.col("rows_equal") > limit).isEmpty()
    share = F.when(F.col("rows_total") > 1, F.col("rows_before") / (F.col("rows_total") - 1)).otherwise(F.lit(0.0))
    out = df
    for value, name in values.items():
        mine = ranks.filter(F.col("_measure") == value)
        sizes = mine.select(*group, "_value", F.col("rows_equal").alias("rows")) if frequent else NONE_HEAVY
        keyed = out.withColumn("_value", F.col(value).cast("double"))
        out = heavy_join(keyed, mine.select(*group, "_value", share.alias(name)), [*group, "_value"], "left", limit=limit, sizes=sizes).drop("_value")
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key. Spark prunes each map task to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key, pruned map-side like :func:`first_per_key`."""
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def newest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Groupwise maximum. Every map task keeps one row per key before the shuffle, so a key with very many rows stays small."""
    first = first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in newest])
    return first.select(*keys, *[c for c in df.columns if c not in keys])
