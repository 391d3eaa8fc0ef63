"""Exact row numbers over whole tables or large classes, without a task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import staged

_PART, _PLACE, _FIRST = "__part", "__place", "__first"


def rank_rows(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), into: str = "rank") -> DataFrame:
    """Adds ``into``, the row's number from 1 in ``order`` over all rows, or inside each class ``within``.

    Rows are dealt to range partitions and sorted there, so a row's place is its place in its
    partition behind the rows of the partitions before it; of these only the counts reach the driver,
    one number per partition. Inside a class the number of the class's first row is taken off. ``order``
    must be total (end it with an identifier): equal rows share a partition and their order is undefined.
    Null classes are one class. An empty table stays empty.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c).asc_nulls_first() for c in within], *order]
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # The low 33 bits of the running number are the place in the partition.
    placed = staged(
        ordered.withColumn(_PART, F.spark_partition_id()).withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked"
    )
    counts = {r[_PART]: r["n"] for r in placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    offsets = F.expr(f"array({', '.join(f'{n}L' for n in before) or '0L'})")
    numbered = placed.withColumn(into, F.col(_PLACE) + F.get(offsets, F.col(_PART)) + 1).drop(_PART, _PLACE)
    if not within:
        return numbered
    firsts = numbered.groupBy(*[F.col(c).alias(f"__{c}") for c in within]).agg(F.min(into).alias(_FIRST))
    same = [numbered[c].eqNullSafe(firsts[f"__{c}"]) for c in within]
    return numbered.join(firsts, same).withColumn(into, F.col(into) - F.col(_FIRST) + 1).drop(_FIRST, *[f"__{c}" for c in within])
