"""Liquid instrument universe and watchlist reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timecol import DAY, HOUR, MINUTE, bucket_of, micros
from tidemark.operators.joins import previous_row
from tidemark.operators.order_stats import percentile_table, top_n_per_group
from tidemark.session import staged

# Gates, weights and watchlists.
QUOTE_SUFFIX = "-USDT-SWAP"
MIN_AGE = 365 * DAY
MIN_TURNOVER = 10_000_000.0
MIN_OPEN_INTEREST = 5_000_000.0
UNIVERSE_SIZE = 60
WEIGHTS = {"turnover": 0.50, "open_interest": 0.35, "age": 0.10, "funding": 0.05}
CRYPTO_WATCHLIST = ("BTC", "ETH", "SOL", "BNB", "XRP", "DOGE", "ADA", "AVAX", "LINK", "TRX", "LTC", "BCH")
STOCK_WATCHLIST = ("SPY", "QQQ", "IWM", "NVDA", "AAPL", "MSFT", "GOOGL", "AMZN", "META", "TSLA", "AMD", "AVGO")
PREVIOUS_WITHIN = 5 * MINUTE


def _positive(value: Column) -> Column:
    return F.coalesce((value > 0) & ~F.isnan(value) & (value != float("inf")), F.lit(False))


def gate(
    instruments: DataFrame,
    as_of: Column,
    asset_class: str,
    min_age: int = MIN_AGE,
    min_turnover: float = MIN_TURNOVER,
    min_open_interest: float = MIN_OPEN_INTEREST,
    allowed: Sequence[str] = (),
    excluded: Sequence[str] = (),
    first: Sequence[str] = ("listed_at", "turnover_24h_usd"),
) -> DataFrame:
    """Instruments passing every hard gate; the bounds themselves pass.

    Of an instrument listed more than once the first passing row in the order of ``first`` counts.
    """
    age = micros(as_of) - micros("listed_at")
    ok = (
        F.col("instrument_id").endswith(QUOTE_SUFFIX) & (F.col("asset_class") == asset_class)
        & _positive(F.col("price_usd")) & _positive(F.col("tick_size")) & F.col("listed_at").isNotNull()
        & (age >= min_age) & _positive(F.col("turnover_24h_usd")) & (F.col("turnover_24h_usd") >= min_turnover)
        & _positive(F.col("open_interest_usd")) & (F.col("open_interest_usd") >= min_open_interest)
    )
    if excluded:
        ok = ok & ~F.col("instrument_id").isin(*excluded)
    if allowed:
        ok = ok & F.col("symbol").isin(*allowed)
    place = F.row_number().over(Window.partitionBy("instrument_id").orderBy(*first))
    once = instruments.filter(ok).withColumn("__n", place).filter("__n = 1").drop("__n")
    return once.withColumn("age_hours", age / float(HOUR))


def liquidity_scores(gated: DataFrame, pool: Sequence[str] = ("asset_class",)) -> DataFrame:
    """Weighted percentiles of turnover, open interest and age inside the pool, plus funding integrity."""
    gated = staged(gated, "gated-instruments")
    out = gated
    for column, name in (("turnover_24h_usd", "p_turnover"), ("open_interest_usd", "p_open_interest"), ("age_hours", "p_age")):
        out = out.join(percentile_table(gated, list(pool), column, name), [*pool, column])
    integrity = F.when(F.col("funding_rate").isNotNull(), 100.0).otherwise(0.0)
    score = (
        F.col("p_turnover") * WEIGHTS["turnover"] + F.col("p_open_interest") * WEIGHTS["open_interest"]
        + F.col("p_age") * WEIGHTS["age"] + integrity * WEIGHTS["funding"]
    )
    return out.withColumn("liquidity_score", score)


def build_universe(gated: DataFrame, size: int = UNIVERSE_SIZE, pool: Sequence[str] = ("asset_class",)) -> DataFrame:
    """The ``size`` most liquid instruments of each pool."""
    order = [F.col("liquidity_score").desc(), F.col("turnover_24h_usd").desc(), F.col("instrument_id")]
    return top_n_per_group(liquidity_scores(gated, pool), list(pool), order, size, size, F.col("instrument_id"))


def refresh_universe(members: DataFrame, batch: DataFrame) -> DataFrame:
    """Keep the members that are still quoted, with the values of the new batch."""
    return members.select("instrument_id").distinct().join(batch, "instrument_id")


def with_previous_observation(
    derivatives: DataFrame, within: int = PREVIOUS_WITHIN, bucket: int = DAY
) -> DataFrame:
    """Short-term changes against the previous observation, only when strictly earlier and recent."""
    out = previous_row(
        derivatives, ["instrument_id"], ["collected_at", "id"], ["collected_at", "price_usd", "open_interest_usd"],
        bucket_of(micros("collected_at"), bucket), "__prev",
    )
    gap = micros("collected_at") - micros("__prev.collected_at")
    near = (gap > 0) & (gap <= within)

    def change(column: str) -> Column:
        now, before = F.col(column), F.col(f"__prev.{column}")
        base = near & (before > 0) & ((now > 0) if column == "price_usd" else now.isNotNull())
        return F.when(base, (now / before - 1) * 100)

    return (
        out.withColumn("price_change_pct", change("price_usd"))
        .withColumn("open_interest_change_pct", change("open_interest_usd")).drop("__prev")
    )


def market_signal(change_24h: Column, oi_change: Column, funding: Column) -> Column:
    """Trend, position and crowding codes joined with `` / ``."""
    trend = (
        F.when(change_24h >= 3, "STRONG").when(change_24h >= 1, "FIRM").when(change_24h <= -3, "WEAK")
        .when(change_24h <= -1, "SOFT").otherwise("SIDEWAYS")
    )
    position = F.when(oi_change >= 5, "ADDING").when(oi_change <= -5, "REDUCING")
    crowd = F.when(funding >= 0.0005, "LONGS_CROWDED").when(funding <= -0.0005, "SHORTS_CROWDED")
    return F.concat_ws(" / ", trend, position, crowd)


def position_quadrant(price_change: Column, oi_change: Column) -> Column:
    """What price and open interest say together over the same short interval."""
    unclear = (F.abs(price_change) < 0.05) | (F.abs(oi_change) < 0.05)
    up, more = price_change > 0, oi_change > 0
    return (
        F.when(price_change.isNull() | oi_change.isNull(), "WAITING").when(unclear, "UNCLEAR")
        .when(up & more, "LONG_ENTRY").when(~up & more, "SHORT_ENTRY").when(up & ~more, "SHORT_COVER").otherwise("LONG_EXIT")
    )


def watchlist(observed: DataFrame, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Watched symbols in their main contract with signal and rank by 24-hour change."""
    wanted = F.lit(False)
    for cls, symbols in lists.items():
        wanted = wanted | ((F.col("asset_class") == cls) & F.col("symbol").isin(*symbols))
    main = F.col("instrument_id") == F.concat(F.col("symbol"), F.lit(QUOTE_SUFFIX))
    rows = observed.filter(wanted & main).withColumn(
        "signal", market_signal(F.col("change_24h_pct"), F.col("open_interest_change_pct"), F.col("funding_rate"))
    )
    order = Window.partitionBy("asset_class").orderBy(F.col("change_24h_pct").desc(), "symbol")
    return rows.withColumn("position", F.row_number().over(order).cast("bigint"))


def watchlist_summary(rows: DataFrame) -> DataFrame:
    """Rising count, strongest and weakest symbol per class."""
    place = F.struct((-F.col("change_24h_pct")).alias("d"), F.col("symbol").alias("s"))
    return rows.groupBy("asset_class").agg(
        F.count_if(F.col("change_24h_pct") > 0).alias("rising"), F.count(F.lit(1)).alias("total"),
        F.min_by("symbol", place).alias("strongest"), F.max("change_24h_pct").alias("strongest_change"),
        F.max_by("symbol", place).alias("weakest"), F.min("change_24h_pct").alias("weakest_change"),
    )
