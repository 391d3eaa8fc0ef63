"""Trade-window statistics anchored at an observation time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import quality as q
from tidemark.functions.timecol import MINUTE, micros

CONCENTRATION_LIMIT = 0.5
STAT_FIELDS = ("buys", "sells", "unique_buyers", "unique_sellers", "buy_volume_usd", "sell_volume_usd", "top_share")


def valid_trades(trades: DataFrame) -> DataFrame:
    """Trades with an address, a known side, a volume and a time."""
    return trades.filter(bad_trade_reason(trades).isNull())


def bad_trade_reason(trades: DataFrame) -> Column:
    return (
        F.when(F.coalesce(F.trim(F.col("address")), F.lit("")) == "", "missing_address")
        .when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "unknown_side")
        .when(F.col("volume_usd").isNull(), "bad_volume")
        .when(F.col("traded_at").isNull(), "bad_time")
    )


def label_windows(joined: DataFrame, at: str, width: int = 5 * MINUTE) -> DataFrame:
    """Mark each trade as current ``[t-w, t]`` or previous ``[t-2w, t-w)``; others are dropped."""
    age = micros(at) - micros("traded_at")
    name = F.when((age >= 0) & (age <= width), "current").when((age > width) & (age <= 2 * width), "previous")
    return joined.withColumn("trade_window", name).filter(F.col("trade_window").isNotNull())


def window_stats(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, distinct addresses, volumes and the top address share per key and window.

    Aggregates per address first, so a hot pool shrinks to its addresses before the second shuffle
    and no distinct set is held in memory.
    """
    keys = [*keys, "trade_window"]
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    zero = F.lit(0.0)
    per_address = labelled.groupBy(*keys, "address").agg(
        F.count_if(buy).alias("b"),
        F.count_if(sell).alias("s"),
        F.sum(F.when(buy, F.col("volume_usd")).otherwise(zero)).alias("bv"),
        F.sum(F.when(sell, F.col("volume_usd")).otherwise(zero)).alias("sv"),
    )
    total = F.sum(F.col("bv") + F.col("sv"))
    return per_address.groupBy(*keys).agg(
        F.sum("b").alias("buys"),
        F.sum("s").alias("sells"),
        F.count_if(F.col("b") > 0).alias("unique_buyers"),
        F.count_if(F.col("s") > 0).alias("unique_sellers"),
        F.sum("bv").alias("buy_volume_usd"),
        F.sum("sv").alias("sell_volume_usd"),
        F.when(total > 0, F.max(F.col("bv") + F.col("sv")) / total).otherwise(zero).alias("top_share"),
    )


def windows_side_by_side(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with ``current`` and ``previous`` structs; an empty window holds zeros."""

    def pack(name: str) -> Column:
        fields = []
        for field in STAT_FIELDS:
            pick = F.max(F.when(F.col("trade_window") == name, F.col(field)))
            fill = F.lit(0.0) if field.endswith("usd") or field == "top_share" else F.lit(0).cast("bigint")
            fields.append(F.coalesce(pick, fill).alias(field))
        return F.struct(*fields).alias(name)

    return stats.groupBy(*keys).agg(pack("current"), pack("previous"))


def trade_evidence(windows: DataFrame, at: str, truncated: Column | None = None, source: str = "trades") -> DataFrame:
    """Score evidence from a pair of windows; a truncated read degrades every value."""
    level = F.when(F.coalesce(truncated, F.lit(False)), q.DEGRADED).otherwise(q.FRESH) if truncated is not None else F.lit(q.FRESH)
    cur, prev, when = F.col("current"), F.col("previous"), F.col(at)

    def tag(value: Column) -> Column:
        return q.tagged(value, level, source, when)

    def volume(side: Column) -> Column:
        return side["buy_volume_usd"] + side["sell_volume_usd"]

    growth = q.open_ratio(cur["unique_buyers"], prev["unique_buyers"])
    return (
        windows.withColumn("buyers_m5", tag(cur["unique_buyers"].cast("double")))
        .withColumn("sellers_m5", tag(cur["unique_sellers"].cast("double")))
        .withColumn("buy_volume_m5_usd", tag(cur["buy_volume_usd"]))
        .withColumn("sell_volume_m5_usd", tag(cur["sell_volume_usd"]))
        .withColumn("buyer_velocity", tag(growth))
        .withColumn("volume_velocity", tag(q.open_ratio(volume(cur), volume(prev))))
        .withColumn("participant_growth", tag(growth))
        .withColumn(
            "concentrated_activity", tag((cur["top_share"] > CONCENTRATION_LIMIT).cast("int").cast("double"))
        )
    )
