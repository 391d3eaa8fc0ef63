"""Effective runs, opportunity episodes and the history leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timecol import DAY, MINUTE, bucket_of, micros
from tidemark.operators.joins import asof_backward
from tidemark.operators.ranks import rank_rows
from tidemark.session import staged

MISSES_TO_END = 3
RUN_BUCKET = 5 * MINUTE
PUBLISHED = ("completed", "degraded")


def effective_runs(runs: DataFrame, as_of: Column | None = None, bucket: int = RUN_BUCKET) -> DataFrame:
    """One published run per class and time bucket, the latest with ties to the highest id, numbered per class.

    Classes are few and time is long, so runs are numbered over range partitions, not in one task per class.
    """
    return rank_rows(_chosen_runs(runs, as_of, bucket), [F.col("finished_at").asc(), F.col("run_id").asc()], within=["asset_class"], into="seq")


def _chosen_runs(runs: DataFrame, as_of: Column | None, bucket: int) -> DataFrame:
    ok = F.col("status").isin(*PUBLISHED) & F.col("finished_at").isNotNull()
    if as_of is not None:
        ok = ok & (F.col("finished_at") <= as_of)
    return (
        runs.filter(ok).groupBy("asset_class", bucket_of(micros("finished_at"), bucket).alias("bucket"))
        .agg(F.max(F.struct("finished_at", "run_id")).alias("r"))
        .select("asset_class", "bucket", "r.*")
    )


def episodes(runs: DataFrame, members: DataFrame, window_start: Column, window_end: Column, bucket: int = RUN_BUCKET) -> DataFrame:
    """Listing episodes per instrument: a new one after three scans in a row without the instrument.

    Counts cover the reporting window only, while an episode keeps its true start. The scan of
    the third miss still counts as experienced and its time is the end of the episode.
    """
    scans = staged(effective_runs(runs, window_end, bucket), "effective-runs")
    edges = scans.groupBy("asset_class").agg(
        F.max("seq").alias("__last_seq"), F.min(F.when(F.col("finished_at") >= window_start, F.col("seq"))).alias("__first_in")
    )
    seen = members.join(scans.select("asset_class", "run_id", "seq", "finished_at"), "run_id")
    order = Window.partitionBy("asset_class", "instrument_id").orderBy("seq")
    gap = F.col("seq") - F.lag("seq").over(order)
    seen = seen.withColumn("__new", F.when(gap.isNull() | (gap > MISSES_TO_END), 1).otherwise(0)).withColumn(
        "episode", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = seen.groupBy("asset_class", "instrument_id", "episode").agg(
        F.min("seq").alias("__s"), F.max("seq").alias("__l"), F.min("finished_at").alias("started_at"),
        F.max("finished_at").alias("last_listed_at"), F.min_by("price", "seq").alias("first_price"),
        F.max_by("symbol", "seq").alias("symbol"),
        F.count_if(F.col("finished_at") >= window_start).alias("appearances"),
    )
    ends = scans.select("asset_class", (F.col("seq") - MISSES_TO_END).alias("__l"), F.col("finished_at").alias("ended_at"))
    joined = found.join(ends, ["asset_class", "__l"], "left").join(edges, "asset_class")
    stop = F.when(F.col("ended_at").isNotNull(), F.col("__l") + MISSES_TO_END).otherwise(F.col("__last_seq"))
    experienced = F.coalesce(
        F.greatest(F.lit(0), stop - F.greatest(F.col("__s"), F.col("__first_in")) + 1), F.lit(0)
    )
    experienced = F.when(F.col("__first_in").isNull(), 0).otherwise(experienced)
    out = joined.withColumn("experienced_scans", experienced.cast("bigint")).withColumn(
        "status", F.when(F.col("ended_at").isNotNull(), "ended").otherwise("active")
    )
    out = out.withColumn(
        "listing_rate",
        F.when(F.col("experienced_scans") > 0, F.col("appearances") / F.col("experienced_scans") * 100).otherwise(F.lit(0.0)),
    )
    return out.filter(F.col("ended_at").isNull() | (F.col("ended_at") >= window_start)).drop(
        "__s", "__l", "__last_seq", "__first_in"
    )


def return_percent(first: Column, evaluation: Column) -> Column:
    return F.when(first > 0, (evaluation - first) / first * 100)


def with_returns(found: DataFrame, derivatives: DataFrame, as_of: Column, bucket: int = DAY) -> DataFrame:
    """Evaluate each episode at its end (or now) with the newest price at or before that time."""
    at = found.withColumn("__at", F.coalesce(F.col("ended_at"), as_of))
    priced = asof_backward(
        at, derivatives, ["asset_class", "instrument_id"], "__at", "collected_at", ["price_usd"], "id", bucket=bucket, into="__p"
    )
    return priced.withColumn("evaluation_price", F.col("__p.price_usd")).withColumn(
        "return_pct", return_percent(F.col("first_price"), F.col("__p.price_usd"))
    ).drop("__at", "__p")


def latest_episode(found: DataFrame) -> DataFrame:
    """The row shown per instrument: its newest visible episode, with the number of visible ones."""
    cols = [c for c in found.columns if c not in ("asset_class", "instrument_id")]
    return (
        found.groupBy("asset_class", "instrument_id")
        .agg(F.max_by(F.struct(*cols), "episode").alias("e"), F.count(F.lit(1)).alias("episodes"))
        .select("asset_class", "instrument_id", "e.*", "episodes")
    )


def leaderboard(rows: DataFrame, sort: str = "rate", direction: str = "desc", status: str = "all") -> DataFrame:
    """Rank instruments of a class by rate, count or return; missing returns always come last."""
    picked = rows if status in ("", "all") else rows.filter(F.col("status") == status)
    column = {"rate": "listing_rate", "count": "appearances", "return": "return_pct"}[sort]
    lead = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_last()
    ties = [F.col("instrument_id")] if sort == "count" else [F.col("appearances").desc(), F.col("instrument_id")]
    return rank_rows(picked, [lead, *ties], within=["asset_class"])


def window_summary(runs: DataFrame, window_start: Column, window_end: Column, bucket: int = RUN_BUCKET) -> DataFrame:
    """Number of effective scans in the window and the time of the last one, per class."""
    inside = F.col("finished_at") >= window_start
    return _chosen_runs(runs, window_end, bucket).groupBy("asset_class").agg(
        F.count_if(inside).alias("effective_scans"), F.max(F.when(inside, F.col("finished_at"))).alias("generated_at")
    )


def latest_published(runs: DataFrame) -> DataFrame:
    """Newest completed or degraded run per class."""
    return (
        runs.filter(F.col("status").isin(*PUBLISHED) & F.col("finished_at").isNotNull()).groupBy("asset_class")
        .agg(F.max(F.struct("finished_at", "run_id", "status")).alias("r")).select("asset_class", "r.*")
    )


def market_health(latest: DataFrame, as_of: Column, limit: int = 10 * MINUTE) -> DataFrame:
    """Ready when the newest published run finished within the limit."""
    return latest.withColumn("ready", micros(as_of) - micros("finished_at") <= limit)
