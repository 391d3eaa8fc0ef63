"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(back) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    seen = near.join(least, "u")
    if large:
        out = seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp) of every node that has an edge (u, v); comp is the component's least node.

    Every round leaves each node's links with its least neighbour, so the depth of the graph falls
    by a constant factor; rounds are written to the shared folder, and only a count and a checksum reach the driver.
    """
    edges = staged(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = _print(edges)
    while before[0]:
        edges = staged(_star(_star(edges, True), False), "edges")
        after = _print(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
