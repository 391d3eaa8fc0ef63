"""A keyed table that micro-batches merge rows into, in any order of arrival.

Layout below ``path``: ``delta/slot=s`` holds the rows of one batch, ``base/_side=i/_bucket=b`` the merged
rows of one bucket of keys, ``manifest/slot=k`` which side of every bucket counts and up to which batch.
A batch writes its delta. Every ``every`` batches the buckets that the deltas since touch are merged
into their other side, and a new manifest makes these count; nothing that is being read is replaced.
Slots and sides are reused, so the number of files does not grow with the number of batches.

A batch that is repeated after a failure overwrites its own slot, or does nothing where the base holds it
already; a compaction that is repeated overwrites sides that do not count yet. Batch numbers are
consecutive, as those of a streaming query are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_BUCKET, _BATCH, _SIDE = "_bucket", "_batch", "_side"


@dataclass(frozen=True)
class KeyedTable:
    """``merge`` turns all rows of a key into the rows that stand for them; it must not matter how rows were merged before."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 32
    every: int = 8

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch; a repeated batch changes nothing."""
        if batch_id <= self.version():
            return
        marked = rows.select(*self._columns(), self._bucket().alias(_BUCKET), F.lit(batch_id).cast("long").alias(_BATCH))
        marked.sortWithinPartitions(_BUCKET).write.mode("overwrite").parquet(f"{self.path}/delta/slot={batch_id % self.every}")
        if (batch_id + 1) % self.every == 0:
            self._compact(batch_id)

    def read(self, before: int | None = None) -> DataFrame:
        """The merged rows, of batches before a number if one is given (of those not yet in the base)."""
        version, sides = self._manifest()
        deltas = self._deltas(version)
        if before is not None:
            deltas = deltas.filter(F.col(_BATCH) < before)
        return self.merge(self._base(sides).unionByName(deltas).select(*self._columns()))

    def holds(self, batch_id: int) -> bool:
        """Whether a batch has been applied."""
        version, _ = self._manifest()
        return batch_id <= version or not self._deltas(version).filter(F.col(_BATCH) == batch_id).isEmpty()

    def version(self) -> int:
        """The last batch that the base holds."""
        return self._manifest()[0]

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, list[int]]:
        stored = table_or_none(self.spark, f"{self.path}/manifest")
        # Two manifests of one number per bucket at most.
        rows = stored.collect() if stored is not None else []
        version = max((r["version"] for r in rows), default=-1)
        sides = {r["bucket"]: r["side"] for r in rows if r["version"] == version}
        return version, [sides.get(b, 0) for b in range(self.buckets)]

    def _deltas(self, version: int) -> DataFrame:
        stored = table_or_none(self.spark, f"{self.path}/delta", f"{self.schema}, {_BUCKET} int, {_BATCH} long")
        if stored is None:
            stored = self.spark.createDataFrame([], f"{self.schema}, {_BUCKET} int, {_BATCH} long")
        return stored.filter(F.col(_BATCH) > version).select(*self._columns(), _BUCKET, _BATCH)

    def _base(self, sides: list[int], buckets: list[int] | None = None) -> DataFrame:
        """Rows of the sides that count; only the folders of the buckets asked for are read."""
        stored = table_or_none(self.spark, f"{self.path}/base", f"{self.schema}, {_SIDE} int, {_BUCKET} int")
        if stored is None:
            stored = self.spark.createDataFrame([], f"{self.schema}, {_SIDE} int, {_BUCKET} int")
        counts = F.col(_SIDE) == F.get(_numbers(sides), F.col(_BUCKET))
        if buckets is not None:
            counts &= F.col(_BUCKET).isin(buckets)
        return stored.filter(counts).select(*self._columns(), _BUCKET, F.lit(-1).cast("long").alias(_BATCH))

    def _compact(self, upto: int) -> None:
        version, sides = self._manifest()
        deltas = self._deltas(version)
        touched = [r[_BUCKET] for r in deltas.select(_BUCKET).distinct().collect()]
        if touched:
            whole = self.merge(self._base(sides, touched).unionByName(deltas).select(*self._columns()))
            flipped = [1 - s if b in touched else s for b, s in enumerate(sides)]
            out = whole.withColumn(_BUCKET, self._bucket()).withColumn(_SIDE, F.get(_numbers(flipped), F.col(_BUCKET)))
            # Adaptive execution splits large buckets and joins small ones, so tasks follow volume.
            out.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_SIDE, _BUCKET).parquet(f"{self.path}/base")
            sides = flipped
        manifest = self.spark.range(0, self.buckets, 1, 1).select(
            F.col("id").cast("int").alias("bucket"), F.get(_numbers(sides), F.col("id").cast("int")).alias("side"), F.lit(upto).cast("long").alias("version")
        )
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/slot={upto // self.every % 2}")


def _numbers(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def table_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A stored table, or None where nothing has been written yet."""
    try:
        reader = spark.read.option("basePath", path)
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
