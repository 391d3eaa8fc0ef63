"""Exact duplicates by content sort.

Rows are range-partitioned on their normalised text (its first characters, then its hash) by Spark's
sampled splitters and sorted externally inside each partition, so equal texts are neighbours. The identifier is part of the sort
key: a text with very many copies spans as many partitions as its rows need. Neighbours are
compared in full while the sorted rows stream by; only the first and last run of a partition can go
on in another one, and those few runs are joined up afterwards.

Defined results: a null text equals the empty text. A null identifier ranks after all others and is
the ``keep_id`` only where every copy's is null. Of repeated rows (same text and identifier) exactly
one is kept. An empty table gives an empty result. Texts of any length are compared whole. Extra columns are
carried by ``drop_duplicates``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, giving_back
from tidemark.session import staged

LEAD = 32  # characters of a splitter


@giving_back
def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours of one sorted partition."""
    part = TaskContext.get().partitionId()
    run, last, digest = -1, None, ""
    for batch in batches:
        runs, firsts, digests = [], [], []
        for text in batch.column("norm").cast(pa.large_binary()):
            value = text.as_buffer()
            new = last is None or value != last
            if new:
                run, last, digest = run + 1, value, hashlib.sha256(value).hexdigest()
            runs.append(run)
            firsts.append(new)
            digests.append(digest)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array(digests, pa.string()), pa.array([part] * n, pa.int32()),
             pa.array(runs, pa.int64()), pa.array(firsts, pa.bool_())],
            names=["row", "id", "text_sha256", "part", "run", "first"],
        )


def sorted_runs(df: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The content-sorted rows: the input row as ``row``, ``id``, ``text_sha256``, ``part``, ``run`` and
    ``first`` (the row to keep of its run), written once to the shared folder."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    base = df.select(
        F.struct("*").alias("row"), F.col(ident).alias("id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm"),
        F.monotonically_increasing_id().alias("seq"),
    )
    rank = F.asc_nulls_last("id") if keep == "smallest" else F.desc_nulls_last("id")
    # Splitters are sampled to the driver, so they hold a short prefix and a hash in place of a whole text.
    base = base.withColumn("lead", F.substring("norm", 1, LEAD)).withColumn("mark", F.xxhash64("norm"))
    ordered = base.repartitionByRange(F.asc("lead"), F.asc("mark"), rank, F.asc("seq")).sortWithinPartitions(
        F.asc("lead"), F.asc("mark"), F.asc("norm"), rank, F.asc("seq")
    )
    schema = T.StructType([
        base.schema["row"], base.schema["id"], T.StructField("text_sha256", T.StringType()), T.StructField("part", T.IntegerType()),
        T.StructField("run", T.LongType()), T.StructField("first", T.BooleanType()),
    ])
    return staged(ordered.mapInArrow(_mark, schema), "content-sort")


def _sizes(runs: DataFrame, keep: str) -> DataFrame:
    """One row per run with size and kept identifier, runs that cross partitions joined up."""
    best = F.min("id") if keep == "smallest" else F.max("id")
    local = runs.groupBy("part", "run", "text_sha256").agg(F.count("*").alias("n"), best.alias("best"))
    edge = local.join(
        F.broadcast(runs.groupBy("part").agg(F.max("run").alias("last"))), "part",  # one row per partition
    ).filter((F.col("run") == 0) | (F.col("run") == F.col("last")))
    best = F.min("best") if keep == "smallest" else F.max("best")
    joined = edge.groupBy("text_sha256").agg(F.sum("n").alias("all_n"), best.alias("all_best"), F.min("part").alias("lead"))
    return local.join(joined, "text_sha256", "left").select(
        "part", "run", F.coalesce("all_n", "n").alias("group_size"), F.coalesce("all_best", "best").alias("keep_id"),
        F.coalesce("lead", "part").alias("lead"),
    )


def duplicate_report(df: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per input row: identifier, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    runs = sorted_runs(df.select(ident, text), text, ident, keep).drop("row")
    return runs.join(_sizes(runs, keep), ["part", "run"]).select(
        F.col("id").alias(ident), "keep_id", "group_size", (F.col("first") & (F.col("part") == F.col("lead"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns."""
    runs = sorted_runs(df, text, ident, keep)
    ends = runs.filter("first").groupBy("part").agg(
        F.min_by("text_sha256", "run").alias("head"), F.max_by("text_sha256", "run").alias("tail"),
    )
    # A partition's first run goes on from an earlier one exactly where that one's last run has the same text.
    again = ends.alias("a").join(ends.alias("b"), F.col("a.head") == F.col("b.tail")).filter(
        F.col("b.part") < F.col("a.part")
    ).select(F.col("a.part").alias("part"), F.lit(0).cast("long").alias("run")).distinct()
    return runs.filter("first").join(F.broadcast(again), ["part", "run"], "left_anti").select("row.*")  # one row per partition at most
