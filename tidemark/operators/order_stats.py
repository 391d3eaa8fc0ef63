"""Exact order statistics and bounded top-n without collecting a group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import staged

_V, _C, _B1, _B2 = "__v", "__cnt", "__b1", "__b2"
RESOLUTION = 128
SUB_BINS = 4096


def signed_log_bin(value: Column, resolution: int = RESOLUTION) -> Column:
    """Order-preserving bin of a double; at most a few thousand bins over the usual range."""
    size = F.floor(F.log1p(F.abs(value) * F.lit(1e6)) * F.lit(float(resolution)))
    return (F.signum(value) * size).cast("bigint")


def _running(df: DataFrame, part: Sequence[str], order: str, base: str | None) -> DataFrame:
    """Rows strictly below each bin, added to the rank the enclosing bin starts at."""
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__n").over(upto), F.lit(0).cast("bigint"))
    return df.withColumn("__below", below if base is None else below + F.col(base))


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    into: str = "median",
    weight: str | None = None,
    expand: Callable[[DataFrame], DataFrame] | None = None,
    fixed: Sequence[str] = (),
) -> DataFrame:
    """Exact median per key, mean of the middle two on even counts; keys without values are absent.

    Equal values are counted first (``weight`` gives rows that already stand for several), then
    the middle ranks are narrowed twice by histogram, and only the values of the one or two bins
    that hold them are sorted. ``expand`` repeats rows into further groups, as a cube does; it is
    applied to the histogram, and to values only of bins that some group needs. ``fixed`` names
    the keys it leaves alone.
    """
    keys = list(keys)
    spread = expand or (lambda rows: rows)
    times = F.col(weight) if weight else F.lit(1)
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias(_V), times.alias("__w"))
        .groupBy(*keys, _V)
        .agg(F.sum("__w").alias(_C))
        .withColumn(_B1, signed_log_bin(F.col(_V)))
    )
    bins = counted.groupBy(*keys, _B1).agg(F.sum(_C).alias("__n"), F.min(_V).alias("__lo"), F.max(_V).alias("__hi"))
    coarse = bins
    if expand is not None:
        coarse = spread(bins).groupBy(*keys, _B1).agg(
            F.sum("__n").alias("__n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")
        )
    coarse = _running(coarse, keys, _B1, None).withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys)))
    coarse = coarse.withColumn("__r1", F.floor((F.col("__total") - 1) / 2)).withColumn(
        "__r2", F.floor(F.col("__total") / 2)
    )
    holds = (F.col("__below") <= F.col("__r2")) & (F.col("__below") + F.col("__n") > F.col("__r1"))
    target = coarse.filter(holds).select(*keys, _B1, "__lo", "__hi", "__r1", "__r2", F.col("__below").alias("__base1"))
    # One or two rows per group. Stored, its true size is known, so the joins below pick their
    # strategy by it and the values are filtered without a shuffle whenever it is small.
    target = staged(target, "median-bins")

    needed = counted
    if expand is not None:
        wanted = target.select(*fixed, _B1).distinct()
        needed = spread(counted.join(wanted, [*fixed, _B1], "left_semi"))
        needed = needed.groupBy(*keys, _V, _B1).agg(F.sum(_C).alias(_C))
    span = F.col("__hi") - F.col("__lo")
    inner = needed.join(target, [*keys, _B1], "inner").withColumn(
        _B2, F.when(span > 0, F.floor((F.col(_V) - F.col("__lo")) / span * F.lit(float(SUB_BINS)))).otherwise(F.lit(0))
    )
    fine = inner.groupBy(*keys, _B1, _B2).agg(
        F.sum(_C).alias("__n"), F.first("__r1").alias("__r1"), F.first("__r2").alias("__r2"),
        F.first("__base1").alias("__base1"),
    )
    fine = _running(fine, [*keys, _B1], _B2, "__base1").filter(holds)
    fine = fine.select(*keys, _B1, _B2, F.col("__below").alias("__base2"))

    rows = inner.join(fine, [*keys, _B1, _B2], "inner")
    upto = Window.partitionBy(*keys, _B1, _B2).orderBy(_V).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__end", F.col("__base2") + F.sum(_C).over(upto))
    return rows.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("__end") > F.col("__r1"), F.col(_V)))
                + F.min(F.when(F.col("__end") > F.col("__r2"), F.col(_V)))
            )
            / 2.0
        ).alias(into)
    )


def pool_percentile(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Rows with their percentile inside the pool."""
    return df.join(percentile_table(df, keys, value, into), [*keys, value], "inner")


def percentile_table(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Per pool and distinct value: 100 * (strictly lower values) / (n - 1); 100 for a pool of one.

    Equal values are counted once, so one frequent value costs one row. Counts inside a histogram
    bin come from a window over (pool, bin); lower bins add their total.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(_C)).withColumn(_B1, signed_log_bin(F.col(value)))
    bins = counted.groupBy(*keys, _B1).agg(F.sum(_C).alias("__n"))
    bins = _running(bins, keys, _B1, None).withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, _B1).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.col("__below") + F.coalesce(F.sum(_C).over(inside), F.lit(0))
    pct = F.when(F.col("__total") <= 1, F.lit(100.0)).otherwise(lower / (F.col("__total") - 1) * F.lit(100.0))
    ranked = counted.join(bins.select(*keys, _B1, "__below", "__total"), [*keys, _B1], "inner")
    return ranked.select(*keys, value, pct.alias(into))


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, limit: int, spread: Column, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of each group by a total order, cut in two rounds.

    The first round ranks within (group, salt) and keeps at most ``limit`` rows each, so the final
    sort of a group sees no more than ``limit * salts`` rows however large the group is. ``n`` may
    be a column (a per-group remainder) as long as it never exceeds ``limit``.
    """
    keys = list(keys)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    cut = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= limit)
    final = Window.partitionBy(*keys).orderBy(*order)
    bound = n if isinstance(n, Column) else F.lit(n)
    return (
        cut.withColumn("__rn", F.row_number().over(final)).filter(F.col("__rn") <= bound).drop("__rn", "__salt")
    )
