"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Candidates are packed into blocks of term-wise postings, query
rows into blocks as well, and every query block meets every candidate block once. Inside a pair of
blocks the terms are taken one at a time: each query weight is multiplied into the term's postings
and scattered into a dense array of scores. A partition selection keeps the k best of each query and
block, and the selections are merged.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part.
Vectors of differing lengths meet on the components they share. Every row is its own candidate, also
where identifiers repeat; only the query's own row is left out. Ties go to the smaller identifier
(nulls last), then to the earlier row. Extra columns play no part, whatever their names. With no queries or candidates the result is empty.
Components are floor(scale * x) and scores must fit 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import tasks
from tidemark.session import staged

BLOCK = 4096  # candidates in a block
QUERIES = 512  # queries in a block
GROUPS = 64  # groups that candidate blocks are dealt to


def integer_vectors(df: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    """Rows ``id``, ``row`` (a running number of its own), ``v`` for every vector that takes part."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(usable).select(
        F.col(ident).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )


def _pack(block: str):
    """Packs a group of vectors, ordered by identifier, into one row of dense little-endian integers."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"], na_position="last")
        width = max(map(len, pdf["v"]), default=0)
        m = np.zeros((len(pdf), width), dtype=np.int64)
        for i, v in enumerate(pdf["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame({
            block: [key[0]], "width": [width], "ids": [pdf["id"].tolist()], "rows": [pdf["row"].tolist()], "m": [m.tobytes()],
        })

    return pack


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of sparse query rows against sparse candidate rows, one term at a time."""
    shared = min(q.shape[1], c.shape[1])
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, shared)
    kind = np.int32 if bound < 2**31 else np.int64
    scores = np.zeros((len(q), len(c)), dtype=kind)
    for term in range(shared):
        holders = np.flatnonzero(q[:, term])
        postings = np.flatnonzero(c[:, term])
        if not len(holders) or not len(postings):
            continue
        weights = c[postings, term].astype(kind)
        if 2 * len(postings) >= len(c):  # a term most rows have: its postings are added as one dense row
            weights = c[:, term].astype(kind)
            for i in holders:
                scores[i] += kind(q[i, term]) * weights
        else:
            for i in holders:
                scores[i, postings] += kind(q[i, term]) * weights
    return scores


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest entries; of equal ones the earlier positions."""
    if k >= len(scores):
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > least)
    chosen = np.concatenate((over, np.flatnonzero(scores == least)[: k - len(over)]))
    return chosen[np.lexsort((chosen, -scores[chosen]))]


def top_k(
    df: DataFrame, is_query: Column, k: int, ident: str = "vec_id", vector: str = "embedding", scale: int = 64,
) -> DataFrame:
    """Rows ``query_id``, ``rank`` (from 1), ident, ``score`` of each query's k best candidates."""
    kind = dict(df.dtypes)[ident]
    rows = staged(integer_vectors(df, ident, vector, scale), "vectors")
    packed = "width int, ids array<%s>, rows array<long>, m binary" % kind

    def blocks(part: DataFrame, name: str, size: int) -> DataFrame:
        n = max(1, -(-part.count() // size))
        grouped = part.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).groupBy(name)
        return grouped.applyInPandas(_pack(name), f"{name} int, {packed}")

    asking = rows.filter(is_query(F.col("id")) if callable(is_query) else is_query)
    q = staged(blocks(asking, "qb", QUERIES), "query-blocks")
    c = staged(blocks(rows, "cb", BLOCK), "candidate-blocks")
    # Every query block meets every candidate block once: an equi-join of blocks on the pair of a query block
    # and a group of candidate blocks, so neither all queries nor all candidates of a block share a task.
    n_queries, n_candidates = (part.agg(F.coalesce(F.max(name), F.lit(-1)).alias("n")).first()["n"] + 1 for part, name in ((q, "qb"), (c, "cb")))
    groups = max(1, min(n_candidates, GROUPS))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias(name)
    sent = c.select(each(n_queries, "qb"), F.pmod("cb", F.lit(groups)).alias("part"), *[F.col(x).alias(f"c_{x}") for x in c.columns])
    asked = q.select(each(groups, "part"), "*")
    spread = max(tasks(df.sparkSession), min(n_queries * groups, 16 * tasks(df.sparkSession)))
    pairs = sent.repartition(spread, "qb", "part").join(asked.repartition(spread, "qb", "part").hint("shuffle_hash"), ["qb", "part"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qm = np.frombuffer(r.m, np.int64).reshape(len(r.ids), r.width)
                cm = np.frombuffer(r.c_m, np.int64).reshape(len(r.c_ids), r.c_width)
                c_rows, c_ids = np.asarray(r.c_rows), np.asarray(r.c_ids, dtype=object)
                scores = accumulate(qm, cm)
                out = []
                for i, (qid, qrow) in enumerate(zip(r.ids, r.rows, strict=True)):
                    best = select(scores[i], k + 1)  # one more, as the query's own row may be among them
                    best = best[c_rows[best] != qrow][:k]
                    out.append(pd.DataFrame({"query_id": qid, "query_row": qrow, "id": c_ids[best], "row": c_rows[best], "score": scores[i][best].astype(np.int64)}))
                yield pd.concat(out)

    found = pairs.mapInPandas(search, f"query_id {kind}, query_row long, id {kind}, row long, score long")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(ident), "score")
