"""Dense numbering, chunks and margins for long ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 1024


def number_rows(df: DataFrame, on: Sequence[str], order: Sequence[str], bucket: Column, into: str = "idx") -> DataFrame:
    """Zero-based position of each row in its series, counted per bucket and offset by earlier buckets."""
    on = list(on)
    work = df.withColumn("__nb", bucket)
    sizes = work.groupBy(*on, "__nb").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*on).orderBy("__nb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*on, "__nb", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*on, "__nb").orderBy(*order)
    return (
        work.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, [*on, "__nb"], "inner")
        .withColumn(into, (F.col("__rn") - 1 + F.col("__off")).cast("bigint"))
        .drop("__rn", "__off", "__nb")
    )


def with_margin(df: DataFrame, idx: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Repeat the rows near a chunk's edges into the neighbouring chunk.

    Adds ``__chunk`` (the chunk a copy serves) and ``__own`` (true on the one copy to keep), so a
    frame of ``before`` preceding and ``after`` following rows is complete inside each chunk.
    """
    home = F.floor(F.col(idx) / chunk).cast("bigint")
    pos = F.pmod(F.col(idx), F.lit(chunk))
    targets = F.array_compact(
        F.array(
            home,
            F.when((pos < after) & (home > 0), home - 1),
            F.when(pos >= chunk - before, home + 1),
        )
    )
    return df.withColumn("__chunk", F.explode(targets)).withColumn(
        "__own", F.col("__chunk") == F.floor(F.col(idx) / chunk)
    )


def drop_margin(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__chunk", "__own")
