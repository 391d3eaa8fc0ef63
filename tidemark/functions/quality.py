"""Quality-tagged values, guarded ratios and threshold ladders.

A tagged value is a struct of value, quality, source and collected_at. A missing measurement is
NULL with quality ``missing``; it is never zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The quality vocabulary and the ladders below.
FRESH, CACHED, DEGRADED, MISSING = "fresh", "cached", "degraded", "missing"
USABLE = (FRESH, CACHED, DEGRADED)
LADDER_STEPS = ("full", "high", "medium", "low", "minimum")
VELOCITY_LADDER = ((4.0, 1.0), (3.0, 0.85), (2.0, 0.65), (1.5, 0.45), (1.1, 0.25))
LIQUIDITY_LADDER = ((0.20, 1.0), (0.10, 0.85), (0.05, 0.65), (0.02, 0.45), (0.01, 0.25))


def tagged(value: Column, quality: Column, source: str | Column = "", at: Column | None = None) -> Column:
    """Build a tagged value; an unusable quality always carries a NULL value."""
    src = source if isinstance(source, Column) else F.lit(source)
    when = at if at is not None else F.lit(None).cast("timestamp")
    return F.struct(
        F.when(quality.isin(*USABLE), value).alias("value"),
        canonical_quality(quality).alias("quality"),
        src.alias("source"),
        when.alias("collected_at"),
    )


def fresh_or_missing(value: Column, source: str | Column = "", at: Column | None = None) -> Column:
    """Tag a nullable measurement: present is fresh, absent is missing."""
    src = source if isinstance(source, Column) else F.lit(source)
    when = at if at is not None else F.lit(None).cast("timestamp")
    return F.struct(
        value.alias("value"), F.when(value.isNotNull(), FRESH).otherwise(MISSING).alias("quality"), src.alias("source"),
        when.alias("collected_at"),
    )


def usable(quality: Column) -> Column:
    """True for fresh, cached or degraded; false for anything else including NULL."""
    return F.coalesce(quality.isin(*USABLE), F.lit(False))


def available(value: Column) -> Column:
    """Availability of a tagged value."""
    return usable(value["quality"])


def canonical_quality(quality: Column) -> Column:
    """Map every unknown quality to ``missing``."""
    return F.when(quality.isin(*USABLE), quality).otherwise(F.lit(MISSING))


def value_if_available(value: Column) -> Column:
    return F.when(available(value), value["value"])


def prefer(primary: Column, fallback: Column) -> Column:
    """The primary tagged value when usable, else the fallback, quality included."""
    return F.when(available(primary), primary).otherwise(fallback)


def divide(numerator: Column, denominator: Column) -> Column:
    """Double division that never raises; NULL on a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def open_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio with a zero denominator read as +Infinity, 0/0 and negative denominators as 0."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return (
        F.when(d > 0, n / d)
        .when((d == 0) & (n > 0), F.lit(float("inf")))
        .when(d.isNotNull() & n.isNotNull(), F.lit(0.0))
    )


def evidence_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of two tagged values; NULL when either is unusable or the denominator is negative."""
    n, d = value_if_available(numerator).cast("double"), value_if_available(denominator).cast("double")
    return F.when(d >= 0, open_ratio(n, d))


def ladder(value: Column, steps: Sequence[tuple[float | Column, float | Column]], maximum: float | Column = 1.0) -> Column:
    """First step whose threshold the value reaches pays ``share * maximum``; none pays 0."""
    top = maximum if isinstance(maximum, Column) else F.lit(float(maximum))
    chain: Column | None = None
    for threshold, share in steps:
        pay = top * (share if isinstance(share, Column) else F.lit(float(share)))
        test = value >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
        chain = F.when(test, pay) if chain is None else chain.when(test, pay)
    return chain.otherwise(F.lit(0.0))


def worst_quality(*qualities: Column) -> Column:
    """degraded beats cached beats fresh; any unusable input gives missing."""
    every = F.lit(True)
    for q in qualities:
        every = every & usable(q)

    def some(level: str) -> Column:
        hit = F.lit(False)
        for q in qualities:
            hit = hit | (q == level)
        return hit

    return (
        F.when(~every, MISSING).when(some(DEGRADED), DEGRADED).when(some(CACHED), CACHED).otherwise(F.lit(FRESH))
    )
