"""Column expressions shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that hands freed memory back to the system when its task ends; workers are used again and would keep it."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        _trim()

    return run


def _trim() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII white-space ones; null counts 0.

    Every such character becomes a blank and every other one an x would cost a pass per class, so
    the text is cut at single blanks, which needs no pattern, and empty cuts are not counted.
    """
    cuts = F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * 6), " ")
    return F.size(F.array_remove(cuts, "")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, ident: str, size: int) -> DataFrame:
    """The rows with the smallest identifier hashes, ``size`` at most, with the hash as ``h``.

    A threshold at twice the wanted share goes first, so no task hands on more rows than that share of its own.
    """
    h = F.xxhash64(F.col(ident))
    part = 2.0 * size / max(1, df.count())
    hashed = df.withColumn("h", h)
    near = hashed if part >= 1 else hashed.filter(F.pmod("h", F.lit(1 << 31)) < int(part * (1 << 31)))
    return near.orderBy(F.pmod("h", F.lit(1 << 31)), "h", ident).limit(size)


def most_frequent(df: DataFrame, count: str, size: int) -> DataFrame:
    """The rows of the largest counts, as many whole size classes (sixteen to a doubling) as hold at most ``size`` rows."""
    level = F.floor(F.log2(F.col(count)) * 16)
    total, least = 0, None
    # As many rows as there are size classes: about a thousand at most.
    for r in df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > size:
            break
        least = r["level"]
    return df.filter(level >= least) if least is not None else df.limit(0)
