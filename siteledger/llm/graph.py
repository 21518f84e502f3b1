"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``u`` and its root ``v`` (the smallest id reachable) for every id that is not a root itself.

    ``links`` has two long columns ``u`` and ``v``, in either order. Every round writes its edges, and ends when they no longer
    change. Minima are aggregated before they meet the edges again, so an id with very many links is only ever a join key,
    which adaptive execution splits.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = scratch.keep(large, "large")
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        moved = large.join(low2, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = scratch.keep(moved.union(low2.select("u", F.col("low").alias("v"))).distinct(), "small")
        scratch.drop(low, large, low2)
        last, state = state, _state(small)
        edges = small
        if state == last:
            break
    return edges
