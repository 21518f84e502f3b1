"""Mixing sources to target weights: certain copies first, the rest of a target by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, spare_name, with_rows

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "mix-1"
BINS = 4096


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the key alone: 48 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Words each source is to give. One row per source, so the windows here hold the list of sources and nothing more.

    A source gets its weight's share of all words, at most ``max_repeat`` times its size; what it cannot take goes to the
    others by weight. In order of size / weight the first sources are the full ones, so one pass over that order finds the level. If the first k
    were full, the level of the others would rise with k up to the right k and fall beyond it, so the right one is the greatest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    final = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything)
    return per.withColumn("target", F.round(F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("weight")), 6)).drop("level", "cap")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
    bins: int = BINS,
) -> DataFrame:
    """Copies of each document in the mix, and the words they give.

    Every document of a source is taken ``floor(target / size)`` times for certain. The rest of the target is a Pareto order
    sample: ``q = (u / (1 - u)) / (p / (1 - p))`` with odds ``p / (1 - p) = f / (1 - f) * sqrt(mean words / words)``, where f
    is the rest's share of the source, and the smallest q are taken up to the rest in words. Short documents have the better
    odds, so a few long ones do not decide a small source. The last document is taken if that comes nearer to the target.

    Returns ``row`` (where ``row_col`` is given), ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``,
    ``taken``. Null text has no words; null is a source of its own, last in order; a source without words has target 0.
    Repeated rows are rows of their own; ties in q go by id, then row. u depends on id and seed only, so reruns agree.
    A source is never sorted: its q are summed in bins, and only the bin where the target falls is put in order.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.lit(None).cast("long")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.keep(
        docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size")),
        "sizes",
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sizes, weights, max_repeat).withColumn("certain", F.floor(rate))
    targets = targets.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    targets = scratch.keep(targets, "targets")

    share = F.col("rest") / F.col("source_size")
    odds = share / (1 - share) * F.sqrt(F.col("source_size") / F.col("n_docs") / F.col("size"))
    u = uniform(F.col("doc_id"), seed)
    q = (u / (1 - u)) / odds
    # Nothing is left to draw, or the document has no words: last in order.
    z = F.when((F.col("rest") > 0) & (F.col("size") > 0), q / (1 + q)).otherwise(1.0)
    same = sizes["source"].eqNullSafe(targets["source"])
    ranked = sizes.join(targets, same).select("row", "doc_id", sizes["source"], "size", "source_size", "target", "certain", "rest", z.alias("z"))
    ranked = scratch.keep(ranked.withColumn("bin", F.least(F.floor(F.col("z") * bins), F.lit(bins - 1)).cast("int")), "ranked")

    per_bin = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bin = per_bin.withColumn("below", F.sum("words").over(upto) - F.col("words")).withColumn("all", F.col("below") + F.col("words"))
    # The first bin in which the words reach the rest of the target.
    cuts = per_bin.filter((F.col("below") < F.col("rest")) & (F.col("all") >= F.col("rest")) & (F.col("rest") > 0))
    cuts = scratch.keep(cuts.select(F.col("source").alias("cut_source"), F.col("bin").alias("cut"), "below"), "cuts")
    placed = ranked.join(cuts, ranked["source"].eqNullSafe(F.col("cut_source")), "left").drop("cut_source")

    order = Window.partitionBy("source").orderBy("z", F.col("doc_id").asc_nulls_last(), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter("bin = cut").withColumn("upto", F.col("below") + F.sum("size").over(order))
    over, under = F.col("upto") - F.col("rest"), F.col("rest") - (F.col("upto") - F.col("size"))
    edge = edge.withColumn("drawn", ((over <= 0) | ((under > 0) & (over < under))).cast("long")).drop("upto")
    rest = placed.filter("cut is null or bin <> cut").withColumn("drawn", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)).cast("long"))
    out = edge.unionByName(rest).withColumn("copies", (F.col("certain") + F.col("drawn")).cast("long"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row with all its columns, as often as it is taken."""
    rows, row = with_rows(docs, Scratch(docs.sparkSession, "repeat"))
    copies, copy = spare_name(rows, "_copies"), spare_name(rows, "_copy")
    taken = mix_sources(rows, row_col=row, **options).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    joined = rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return joined.drop(row, copies, copy)
