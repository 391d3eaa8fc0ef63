"""Shards by a k-d tree over document metadata; DataFrame operations only.

Every node holds a part of the total bytes and is split in two along the dimension in which its
documents spread widest, at the distributed weighted median, until each leaf holds one shard's
bytes. A median is found by counting bytes in bins of the node's range and looking again into the
bin where the middle falls; rows equal in the dimension are told apart by their text's checksum and
then by a hash of the row, so a large group of copies is cut where the bytes demand it and all other
groups stay together. Only the cut of each node (one row of numbers) reaches the driver.

Defined results: a null text has no bytes; null metadata sort before all values; a null or repeated
identifier is an ordinary row; of rows equal in all that is read, any may be the one beyond a cut. Texts of
any length count whole and lie in one shard. Extra columns play no part, whatever their names. With no rows the result is empty; with fewer rows than shards some
shards stay empty. Slots number the rows of a shard from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

BINS = 1024
#: A cut is exact enough once the bin that holds the median weighs less than this part of its node.
SLACK = 0.0005
ROWS_PER_BUCKET = 50_000
LAST_TIE = (1 << 62) - 1


def narrow(df: DataFrame, ident: str, text: str, dims: dict[str, Column]) -> DataFrame:
    """Identifier, size, checksum, integer coordinates and tie-breaker of every row."""
    content = F.crc32(F.coalesce(F.col(text), F.lit("")))
    seq = F.monotonically_increasing_id()
    return df.select(
        F.col(ident).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), content.alias("crc"),
        # checksum above, row hash below: 32 + 31 bits
        (F.shiftleft(F.pmod(content, F.lit(1 << 32)), 30) + F.pmod(F.xxhash64(F.col(ident), seq), F.lit(1 << 30))).alias("tie"), seq.alias("seq"),
        F.array(*[F.coalesce(c.cast("long"), F.lit(-1)) for c in dims.values()]).alias("d"), F.lit(0).alias("node"),
    )


def _widest(rows: DataFrame, n_dims: int) -> dict[int, tuple[int, int, int, int]]:
    """Of each node: widest dimension (by share of the whole range), its least and greatest value, bytes."""
    aggs = [f(F.col("d")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *aggs).collect()  # as many rows as shards at most
    spans = [max(r[f"hi{i}"] for r in stats) - min(r[f"lo{i}"] for r in stats) + 1 for i in range(n_dims)] if stats else []
    out = {}
    for r in stats:
        i = max(range(n_dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / spans[i], -i))
        out[r["node"]] = (i, r[f"lo{i}"], r[f"hi{i}"], r["w"])
    return out


def _with(rows: DataFrame, per_node: list[tuple], schema: str) -> DataFrame:
    """Adds what is known of each node; there are no more nodes than shards, so they are literals of the plan."""
    literal = lambda v: f"{v!r}D" if isinstance(v, float) else f"{v}L"
    names, kinds = zip(*(part.split() for part in schema.split(", ")), strict=True)
    values = ", ".join(f"({', '.join(map(literal, row))})" for row in per_node)
    known = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS known({', '.join(names)})")
    return rows.join(F.broadcast(known.select(*[F.col(n).cast(k) for n, k in zip(names, kinds, strict=True)])), "node")


def _cuts(rows: DataFrame, shares: dict[int, float], start: dict[int, tuple]) -> dict[int, tuple[int, int, int]]:
    """For each node the dimension and the last (coordinate, tie) that goes left."""
    cuts: dict[int, tuple[int, int, int]] = {}
    # What is open of a node: phase (0 coordinate, 1 tie), fixed coordinate, range, bytes before it, bytes wanted on the left.
    todo = {k: (0, 0, lo, hi, 0, shares[k] * w) for k, (_, lo, hi, w) in start.items() if k in shares}
    while todo:
        known = [(k, start[k][0], ph, fix, lo, hi, (hi - lo) // BINS + 1, want - before) for k, (ph, fix, lo, hi, before, want) in todo.items()]
        seen = _with(rows, known, "node int, dim int, phase int, fix long, lo long, hi long, step long, want double").selectExpr(
            "node", "size", "lo", "step", "want", "IF(phase = 0, d[dim], IF(d[dim] = fix, tie, -2)) AS at", "hi"
        ).filter("at BETWEEN lo AND hi")
        bins = seen.groupBy("node", "want", F.expr("(at - lo) div step").alias("bin")).agg(F.sum("size").alias("w"))
        upto = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        # The first bin that reaches the wanted bytes; rounding may leave none, then the last bin is it.
        x = F.struct("bin", "w", "upto")
        hits = upto.groupBy("node").agg(
            F.coalesce(F.min_by(x, F.when(F.col("upto") >= F.col("want"), F.col("bin"))), F.max_by(x, "bin")).alias("x")
        ).collect()  # one row per node
        again = {}
        for r in hits:
            k = r["node"]
            phase, fix, a, b, before, wanted = todo[k]
            width = (b - a) // BINS + 1
            left = a + r["x"]["bin"] * width
            right = min(b, left + width - 1)
            before += r["x"]["upto"] - r["x"]["w"]
            if r["x"]["w"] <= SLACK * start[k][3] or (phase == 1 and width == 1):
                inside = wanted - before > r["x"]["w"] / 2  # the bin goes to the side nearer the middle
                edge = right if inside else left - 1
                cuts[k] = (start[k][0], edge, LAST_TIE) if phase == 0 else (start[k][0], fix, edge)
            elif width == 1:
                again[k] = (1, left, 0, LAST_TIE, before, wanted)
            else:
                again[k] = (phase, fix, left, right, before, wanted)
        todo = again
    return cuts


def kd_shards(
    df: DataFrame, shards: int, ident: str = "doc_id", text: str = "text", dims: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: identifier, ``size`` (bytes of the text plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``dims`` are the metadata dimensions, as numbers. A node that must hold k shards gives k // 2 of
    them to its left side, so any number of shards works. A node is named by its first shard.
    """
    dims = dims or {"bytes": F.octet_length(text)}
    rows = staged(narrow(df, ident, text, dims), "kd-rows")
    held = {0: shards}  # node -> number of its shards
    while any(n > 1 for n in held.values()):
        split = {k: n for k, n in held.items() if n > 1}
        start = _widest(rows.filter(F.col("node").isin(list(split))), len(dims))
        cuts = _cuts(rows, {k: (n // 2) / n for k, n in split.items()}, start)
        moves = [(k, *cuts.get(k, (0, 0, 0)), k + held[k] // 2 if k in cuts else k) for k in held]
        rows = staged(_with(rows, moves, "node int, dim int, cut long, cut_tie long, right int").selectExpr(
            *(c for c in rows.columns if c != "node"),
            "IF(d[dim] < cut OR (d[dim] = cut AND tie <= cut_tie), node, right) AS node",
        ), "kd-level")
        held = {k: n for old, m in held.items() for k, n in ([(old, m // 2), (old + m // 2, m - m // 2)] if m > 1 else [(old, m)])}
    return with_slots(rows.withColumnRenamed("node", "shard")).select(
        F.col("id").alias(ident), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of every shard from 0: inside salted buckets, after the rows of the buckets before."""
    buckets = max(1, -(-placed.count() // ROWS_PER_BUCKET))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("tie", "seq"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("shard", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("tie", "seq")) - 1
    return salted.withColumn("inside", inside).join(before, ["shard", "salt"]).withColumn("slot", (F.col("inside") + F.col("before")).cast("long"))
