"""As-of, interval and neighbour lookups that stay parallel inside one hot key.

Every helper splits a key's timeline into fixed time buckets, so a token holding a third of all
rows is spread over (key, bucket) groups. What one bucket needs from earlier ones travels as one
summary row per bucket, or as a thin margin of replicated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timecol import DAY, HOUR, bucket_of, micros

_B, _T, _SIDE, _TIE, _ROW, _PAY = "__bucket", "__t", "__side", "__tie", "__row", "__pay"


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    tiebreak: str | None = None,
    strict: bool = False,
    bucket: int = DAY,
    into: str = "asof",
) -> DataFrame:
    """Attach the newest right row at or before (strictly before) each left row as a struct.

    Ties on time go to the highest ``tiebreak``. Left rows without a match keep a NULL struct.
    """
    on = list(on)
    tie = F.col(tiebreak).cast("bigint") if tiebreak else F.lit(0).cast("bigint")
    pay = F.struct(*[F.col(c) for c in take])
    r = right.select(*on, micros(right_time).alias(_T), F.lit(1).alias(_SIDE), tie.alias(_TIE), pay.alias(_PAY))
    pay_type = r.schema[_PAY].dataType
    ltime = micros(left_time)
    l = left.select(
        *on,
        ltime.alias(_T),
        F.lit(0 if strict else 2).alias(_SIDE),
        F.lit(None).cast("bigint").alias(_TIE),
        F.struct(*left.columns).alias(_ROW),
        F.lit(None).cast(pay_type).alias(_PAY),
    )
    row_type = l.schema[_ROW].dataType
    both = l.unionByName(r.withColumn(_ROW, F.lit(None).cast(row_type))).withColumn(_B, bucket_of(_T, bucket))

    inside = Window.partitionBy(*on, _B).orderBy(_T, _SIDE, _TIE).rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("__local", F.last(_PAY, ignorenulls=True).over(inside)).filter(F.col(_ROW).isNotNull())

    newest = r.withColumn(_B, bucket_of(_T, bucket)).groupBy(*on, _B).agg(
        F.max_by(_PAY, F.struct(_T, _TIE)).alias("__last")
    )
    wanted = left.select(*on, bucket_of(ltime, bucket).alias(_B)).distinct()
    before = Window.partitionBy(*on).orderBy(_B, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (
        wanted.withColumn("__last", F.lit(None).cast(pay_type)).withColumn("__kind", F.lit(0))
        .unionByName(newest.withColumn("__kind", F.lit(1)))
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(before))
        .filter(F.col("__kind") == 0)
        .select(*on, _B, "__carry")
    )
    joined = local.join(carry, [*on, _B], "left")
    return joined.select(f"{_ROW}.*", F.coalesce("__local", "__carry").alias(into))


def asof_instants(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    instants: Mapping[str, Column],
    right_time: str,
    take: Sequence[str],
    tiebreak: str | None = None,
    bucket: int = DAY,
) -> DataFrame:
    """Attach, under each name, the newest right row at or before that instant of the left row.

    A left row asks once per instant in one union with the right rows, so these are shuffled once
    however many instants there are; its answers are then put side by side.
    """
    asks = F.array(*[F.struct(F.lit(name).alias("name"), at.alias("at")) for name, at in instants.items()])
    asking = left.withColumn("__id", F.monotonically_increasing_id()).select("*", F.explode(asks).alias("__ask")).select("*", F.col("__ask.at").alias("__at"))
    found = asof_backward(asking, right, on, "__at", right_time, take, tiebreak, bucket=bucket, into="__found")
    answers = [F.max(F.when(F.col("__ask.name") == name, F.col("__found"))).alias(name) for name in instants]
    return found.groupBy("__id").agg(F.first(F.struct(*left.columns)).alias(_ROW), *answers).select(f"{_ROW}.*", *instants)


def interval_join(
    intervals: DataFrame,
    points: DataFrame,
    on: Sequence[str],
    start: str,
    end: str,
    time: str,
    condition: Column | None = None,
    bucket: int = HOUR,
) -> DataFrame:
    """Inner join of points falling in ``[start, end]`` of an interval with the same key.

    The equi-key is (key, time bucket): intervals are repeated once per bucket they touch and
    points go to exactly one bucket, so no pair is produced twice. Column names other than the
    keys must not clash.
    """
    on = list(on)
    spread = intervals.withColumn(
        _B, F.explode(F.sequence(bucket_of(micros(start), bucket), bucket_of(micros(end), bucket)))
    )
    keyed = points.withColumn(_B, bucket_of(micros(time), bucket))
    within = (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))
    joined = spread.join(keyed, [*on, _B], "inner").filter(within if condition is None else within & condition)
    return joined.drop(_B)


def previous_row(
    df: DataFrame,
    on: Sequence[str],
    order: Sequence[str],
    take: Sequence[str],
    bucket: Column,
    into: str = "previous",
) -> DataFrame:
    """The row just before each row of its key, as a struct; NULL on a key's first row.

    ``bucket`` must be non-decreasing along ``order``.
    """
    on, order = list(on), list(order)
    work = df.withColumn(_B, bucket).withColumn(_PAY, F.struct(*take))
    inside = Window.partitionBy(*on, _B).orderBy(*order)
    local = work.withColumn("__local", F.lag(_PAY).over(inside))
    tails = work.groupBy(*on, _B).agg(F.max_by(_PAY, F.struct(*order)).alias("__tail"))
    carry = tails.select(*on, _B, F.lag("__tail").over(Window.partitionBy(*on).orderBy(_B)).alias("__carry"))
    return (
        local.join(carry, [*on, _B], "left")
        .withColumn(into, F.coalesce("__local", "__carry"))
        .drop(_B, _PAY, "__local", "__carry")
    )


def first_in_lookback(
    df: DataFrame,
    on: Sequence[str],
    time: str,
    tiebreak: str,
    take: Sequence[str],
    lookback: int,
    bucket: int = HOUR,
    into: str = "earlier",
) -> DataFrame:
    """Earliest row of the key in ``[t - lookback, t)`` as a struct, ties to the lowest id.

    A forward as-of: every row asks at ``t - lookback`` for the next row, and one running pass from
    late to early answers all questions of a bucket. A row is repeated into the bucket before only
    when it lies within ``lookback`` of the boundary.
    """
    on = list(on)
    width = max(bucket, lookback)
    t = micros(time)
    points = df.select(
        *on, t.alias(_T), F.lit(1).alias(_SIDE), F.col(tiebreak).cast("bigint").alias(_TIE), F.struct(t.alias("at"), F.struct(*take).alias("row")).alias(_PAY),
    ).withColumn("__home", bucket_of(_T, width))
    near = F.col(_T) - F.col("__home") * width < lookback
    points = points.withColumn(_B, F.explode(F.when(near, F.array(F.col("__home") - 1, "__home")).otherwise(F.array("__home")))).drop("__home")
    row = F.struct(*df.columns)
    asks = df.select(
        *on, (t - lookback).alias(_T), F.lit(0).alias(_SIDE), F.lit(None).cast("bigint").alias(_TIE), F.lit(None).cast(points.schema[_PAY].dataType).alias(_PAY), row.alias(_ROW),
    ).withColumn(_B, bucket_of(_T, width))
    both = asks.unionByName(points.withColumn(_ROW, F.lit(None).cast(asks.schema[_ROW].dataType)))
    back = Window.partitionBy(*on, _B).orderBy(F.desc(_T), F.desc(_SIDE), F.desc(_TIE)).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__next", F.last(_PAY, ignorenulls=True).over(back)).filter(F.col(_ROW).isNotNull())
    earlier = F.when(F.col("__next.at") < F.col(_T) + lookback, F.col("__next.row"))
    return found.select(f"{_ROW}.*", earlier.alias(into))
