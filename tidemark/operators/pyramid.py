"""Summaries of many time ranges from a pyramid of blocks that double in length.

Level 0 cuts every key's time into blocks of ``base`` microseconds; a block of the next level is two of
the level below. A block keeps how many points it holds, their least and greatest value and their least
identifier. A range is made of at most two blocks of each level, and of the points in the two blocks of
level 0 it ends in, so a range over n blocks reads O(log n) rows instead of every point, however many
ranges overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timecol import MINUTE, bucket_of, micros

LEVELS = 12


def block_pyramid(points: DataFrame, on: Sequence[str], time: str, value: str, ident: str, base: int, levels: int = LEVELS) -> DataFrame:
    """Rows (on, level, block, n, least, greatest, least_id) of all blocks that hold a point."""
    on = list(on)
    lowest = points.groupBy(*on, bucket_of(micros(time), base).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.min(ident).alias("least_id")
    )
    # Points are gone before levels multiply the rows.
    every = lowest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("block", F.expr("shiftright(block, level)"))
    return every.groupBy(*on, "level", "block").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.min("least_id").alias("least_id")
    )


def covering_blocks(first: Column, behind: Column, levels: int = LEVELS) -> Column:
    """The fewest blocks (level, block) that make up the blocks of level 0 from ``first`` to before ``behind``."""
    taken = []
    low, high = first, behind
    for level in range(levels - 1):
        some = low < high
        place = lambda block, level=level: F.struct(F.lit(level).alias("level"), block.cast("long").alias("block"))
        taken += [F.when(some & (low % 2 != 0), place(low)), F.when(some & (high % 2 != 0), place(high - 1))]
        low, high = F.floor((low + 1) / 2), F.floor(high / 2)
    rest = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda b: F.struct(F.lit(levels - 1).alias("level"), b.cast("long").alias("block"))))
    return F.concat(F.array_compact(F.array(*taken)), F.coalesce(rest, F.array().cast("array<struct<level:int,block:bigint>>")))


def range_summaries(
    ranges: DataFrame, points: DataFrame, on: Sequence[str], start: str, end: str, after: str, time: str, value: str, ident: str,
    base: int = 15 * MINUTE, levels: int = LEVELS,
) -> DataFrame:
    """Adds ``n``, ``least`` and ``greatest`` of the points later than ``start``, up to ``end``, with an identifier above ``after``.

    Ranges must be distinct in these columns; a range without points is left out. A block with an
    identifier that is not above ``after`` is not taken as a whole: its points are looked at instead.
    """
    on = list(on)
    key = [*on, start, end, after]
    from_us, to_us = micros(start), micros(end)
    first, behind = bucket_of(from_us, base) + 1, F.floor((to_us + 1) / base)
    asked = ranges.select(*key).withColumn("__first", first).withColumn("__behind", behind)
    whole = asked.select(*key, F.inline(covering_blocks(F.col("__first"), F.col("__behind"), levels)))
    met = whole.join(block_pyramid(points, on, time, value, ident, base, levels), [*on, "level", "block"])
    taken = met.filter(F.col("least_id") > F.col(after)).select(*key, "n", "least", "greatest")
    # Blocks of level 0 of which only some points count: the ends of a range, and blocks with too low an identifier.
    ends = F.array_distinct(F.array(F.col("__first") - 1, bucket_of(to_us, base)))
    outside = F.filter(ends, lambda b: (b < F.col("__first")) | (b >= F.col("__behind")))
    below = F.sequence(F.expr("shiftleft(block, level)"), F.expr("shiftleft(block + 1, level) - 1"))
    edges = asked.select(*key, F.explode(outside).alias("block")).unionByName(
        met.filter(F.col("least_id") <= F.col(after)).select(*key, F.explode(below).alias("block"))
    )
    keyed = points.select(*on, F.col(time).alias("__t"), F.col(value).alias("__v"), F.col(ident).alias("__i"), bucket_of(micros(time), base).alias("block"))
    inside = (F.col("__t") > F.col(start)) & (F.col("__t") <= F.col(end)) & (F.col("__i") > F.col(after))
    single = edges.join(keyed, [*on, "block"]).filter(inside).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("greatest")
    )
    return taken.unionByName(single).groupBy(*key).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
