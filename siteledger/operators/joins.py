"""Equi-joins whose frequent keys are dealt to several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..session import cut

HEAVY_ROWS = 1_000_000  # rows of one key that a task of a join may hold
BROADCAST_KEYS = 100_000  # frequent keys that are sent to every task; more of them are joined
NONE_HEAVY = "none"  # stands for the sizes where it is known that no key is frequent
NULL_PARTS = 1024  # rows with a null key match nothing and are spread over so many tasks


def heavy_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *, limit: int = HEAVY_ROWS, sizes: DataFrame | str | None = None,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``left`` in which a few keys may hold most rows; ``how`` is inner, left or left_semi.

    Keys with more than ``limit`` rows on the left are cut into parts of about that size by a hash of the ``spread`` columns (all that can
    be hashed, unless given), and their rows on the right are repeated once per part, so keep the side with few rows per key on the
    right. There are at most rows / ``limit`` such keys. ``sizes`` (keys and ``rows``, or ``NONE_HEAVY``) saves the count where it is
    known; else ``left`` is read twice and should be materialised.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how must be inner, left or left_semi")
    keys = list(keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    n, heavy = 0, None
    if sizes is not NONE_HEAVY:
        if sizes is None:
            sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        heavy = cut(sizes.filter(known & (F.col("rows") > limit)).select(*keys, F.ceil(F.col("rows") / limit).cast("int").alias("_parts")))
        n = heavy.count()
    spread = spread or [f.name for f in left.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in spread])
    if not n:
        loose = left.withColumn("_salt", F.when(known, 0).otherwise(F.pmod(mixed, F.lit(NULL_PARTS))))
        return loose.join(right.withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"], how).drop("_salt")
    few = F.broadcast(heavy) if n <= BROADCAST_KEYS else heavy
    parts = F.when(known, F.coalesce("_parts", F.lit(1))).otherwise(NULL_PARTS)
    dealt = left.join(few, keys, "left").withColumn("_salt", F.pmod(mixed, parts)).drop("_parts")
    copies = right.join(few, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
