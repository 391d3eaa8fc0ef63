"""Importance resampling of documents towards the distribution of a target corpus.

Features (runs of consecutive words) fall into buckets by CRC-32. Both corpora are counted whole, per
bucket: every task counts its rows into one array and hands that on. The gains of the buckets are an
array that goes to every task; a document's weight is the floored mean of its features' entries, and
seeded Gumbel noise on it makes taking the highest scores the same as drawing without replacement.

The draw is a distributed quickselect. Rows carry a composite key, score first, then identifier, a
hash of the text and the row's number, so no two keys are equal. Each round picks ``PIVOTS`` keys at
random, counts how many rows lie before, on and after each of them, and goes on with the rows between
two neighbours, until a pivot is the k-th key. Rows up to it are the winners, and they alone are
sorted and ranked. Nothing but pivots and counts reaches the driver.

Defined results: null and empty texts have no feature, weight 0, and are too short to be drawn. Texts of
any length are read whole. Of equal scores the smaller identifier is drawn, null ones last; the noise of
a null identifier is that of an empty one. Of rows equal in identifier and text as many are drawn as fall
within the draw, whichever they are. Tables without rows, and draws of none, are no special case. Extra
columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.bytewords import MARKS, Words, words
from tidemark.operators.ranks import rank_rows
from tidemark.session import staged

PIVOTS = 15
_SLICE = 1000
_LONG = 40  # bytes of a feature from which its checksum is computed on its own


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many spans of a buffer: byte by byte over all spans that are long enough."""
    order = np.argsort(np.minimum(ends - starts, _LONG + 1).astype(np.uint8), kind="stable")
    begin, size = starts[order], (ends - starts)[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(min(_LONG, int(size[-1]) if len(size) else 0)):
        a = int(np.searchsorted(size, j, side="right"))
        part = crc[a:]
        crc[a:] = _CRC[(part ^ data[begin[a:] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(size, _LONG, side="right")), len(size)):
        crc[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(w: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of 1 to ``longest`` words of every text, text after text, and the number of each text's runs."""
    n = w.counts()
    data, starts, ends = w.data, w.starts, w.ends
    if longest > 1:  # runs are joined by one blank: a copy with one blank after each word holds each run as a span
        size = ends - starts + 1
        to = np.cumsum(size)
        data = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
        inside = np.arange(len(data)) - np.repeat(to - size, size)
        within = inside < np.repeat(size - 1, size)
        data[within] = w.data[(np.repeat(starts, size) + inside)[within]]
        starts, ends = to - size, to - 1
    found, owner = [], []
    for k in range(1, longest + 1):
        each = np.maximum(n - k + 1, 0)
        first = np.arange(int(each.sum())) + np.repeat(w.first[:-1] - (np.cumsum(each) - each), each)
        found.append(crc32_of(data, starts[first], ends[first + k - 1]) % np.uint32(buckets))
        owner.append(np.repeat(np.arange(len(n)), each))
    if longest == 1:
        return found[0], n
    owners = np.concatenate(owner)
    return np.concatenate(found)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(n))


def bucket_counts(df: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                found, _ = features(words(batch.column(0).slice(at, _SLICE), MARKS), longest, buckets)
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Floored thousandfold log-ratio of the smoothed shares of every bucket."""
    t, s, buckets = target.astype(np.float64), corpus.astype(np.float64), len(target)
    ratio = ((t + 1) * float(int(corpus.sum()) + buckets)) / ((s + 1) * float(int(target.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(ident: Column, seed: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(df: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """Rows (id, tie, row, n_words, n_features, weight) of a table (id, text)."""
    base = df.select(F.struct("id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")).alias("own"), "text")
    shared = df.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    kind = base.schema["own"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                w = words(batch.column("text"), MARKS)
                found, n = features(w, longest, len(table))
                sums = np.concatenate(([0], np.cumsum(table[found])))
                ends = np.cumsum(n)
                weight = np.floor_divide(sums[ends] - sums[ends - n], np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(w.counts()), pa.array(n), pa.array(weight)], names=["own", "n_words", "n_features", "weight"])

    return base.mapInArrow(score, f"own {kind}, n_words long, n_features long, weight long").select("own.*", "n_words", "n_features", "weight")


def composite_key() -> Column:
    """Order of the draw: higher scores first, then smaller identifiers, null ones last; the row's number makes it unique."""
    return F.struct((-F.col("score")).alias("score"), F.col("id").isNull().alias("absent"), F.col("id").alias("id"), F.col("tie").alias("tie"), F.col("row").alias("row"))


def kth_key(keys: DataFrame, k: int, seed: int = 1) -> Row | None:
    """The k-th least of the unique values of the struct column ``key``; None where there are fewer."""
    kinds = keys.schema["key"].dataType

    def literal(key: Row) -> Column:
        return F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kinds])

    live, turn = keys.select("key"), seed
    while True:
        picked = live.orderBy(F.xxhash64("key.row", F.lit(turn)), "key.row").limit(PIVOTS).sort("key").collect()
        if not picked:
            return None
        pivots = [r["key"] for r in picked]
        key = F.col("key")
        counts = live.agg(*[
            c for i, p in enumerate(pivots) for c in (F.count_if(key < literal(p)).alias(f"before{i}"), F.count_if(key == literal(p)).alias(f"on{i}"))
        ]).first()
        passed, low, high = 0, None, None
        for i, p in enumerate(pivots):
            if counts[f"before{i}"] >= k:
                high = p
                break
            if counts[f"before{i}"] + counts[f"on{i}"] >= k:
                return p
            passed, low = counts[f"before{i}"] + counts[f"on{i}"], p
        between = F.lit(True)
        if low is not None:
            between &= key > literal(low)
        if high is not None:
            between &= key < literal(high)
        live, k, turn = staged(live.filter(between), "quickselect"), k - passed, turn + 1


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000,
    seed: str = "2024", ident: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """Per document: identifier, ``n_features``, ``weight``, ``score`` and ``rank``, which is null where it is not drawn."""
    gains = gains_of(bucket_counts(target, target_text, longest, buckets), bucket_counts(docs, text, longest, buckets))
    slim = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    weighed = weigh(slim, gains, longest).withColumn("score", F.col("weight") + _noise(F.col("id"), seed))
    scored = staged(weighed.withColumn("fit", F.col("n_words") >= least_words).drop("n_words"), "importance")
    keyed = scored.withColumn("key", composite_key())
    k = scored.filter("fit").count() * percent // 100
    last = kth_key(keyed.filter("fit"), k) if k else None
    out = [F.col("id").alias(ident), "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    kinds = keyed.schema["key"].dataType
    bound = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds])
    drawn = F.col("fit") & (F.col("key") <= bound)
    winners = rank_rows(keyed.filter(drawn), [F.col("key").asc()], into="rank")
    return winners.select(*out, "rank").unionByName(keyed.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
