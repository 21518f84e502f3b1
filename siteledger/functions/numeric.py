"""Rounding, clamping and severity helpers shared by the scoring functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order and bands.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
BANDS = ("P0", "P1", "P2", "P3")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def num(c: Column | str) -> Column:
    """Numeric value with missing read as zero."""
    return F.coalesce(dbl(c), F.lit(0.0))


def rnd(c: Column | str, digits: int) -> Column:
    """Half-up rounding that first drops summation noise beyond eight decimals.

    Sums arrive in a different order on every run of a distributed job; quantising first makes the
    rounded value independent of that order.
    """
    return F.round(F.round(dbl(c), 8), digits)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bounded value; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def log_scale(c: Column | str) -> Column:
    """log1p of a count, negatives and missing read as zero."""
    return F.log1p(F.greatest(F.lit(0.0), num(c)))


def lookup(c: Column, table: dict, default) -> Column:
    """Literal map lookup: the map folds to a constant and the key is evaluated once."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(c: Column | str) -> Column:
    return lookup(F.upper(col(c)), SEVERITY_RANK, 0)


def severity_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()}, "NONE")


def health_category(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when(s > 90.0, "LOW ISSUES").when(s >= 75.0, "MEDIUM ISSUES").when(s.isNotNull(), "HIGH ISSUES")
    )


def technical_band(severity: Column | str) -> Column:
    return lookup(F.upper(col(severity)), {"CRITICAL": "P0", "HIGH": "P1", "MEDIUM": "P2"}, "P3")
