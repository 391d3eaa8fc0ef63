"""Bars: resampling, validity, pivots, breakouts and the per-series reading at the end of the history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.functions.timecol import DAY, HOUR, MINUTE, bucket_of, floor_to, micros, plus
from tidemark.operators.series import drop_margin, number_rows, with_margin
from tidemark.operators.smoothing import indicators
from tidemark.session import staged

# Bar lengths, look-backs and the smallest usable history.
FRAMES = {"15m": 15 * MINUTE, "1H": HOUR, "4H": 4 * HOUR, "1Dutc": DAY}
SERIES = ("instrument_id", "timeframe")
MIN_COMPLETED = 50
LOOKBACK = 20
PLAN_BARS = 60


def resample(ticks: DataFrame, as_of: Column, frames: Mapping[str, int] = FRAMES, order: Sequence[str] = ()) -> DataFrame:
    """Bars of every frame from ticks (traded_at, price, base_volume, quote_volume).

    Ticks shrink to bars of the shortest frame first; longer frames roll those up, so the tick
    rows are read and partially aggregated once however many frames are asked for.
    """
    base = min(frames.values())
    if any(width % base for width in frames.values()):
        raise ValueError("every frame must be a multiple of the shortest")
    seq = F.struct("traded_at", *order)
    small = ticks.groupBy("instrument_id", floor_to("traded_at", base).alias("__at")).agg(
        F.min_by("price", seq).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", seq).alias("c"), F.sum("base_volume").alias("vb"), F.sum("quote_volume").alias("vq"),
    )
    each = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(w).alias("__w")) for n, w in frames.items()])
    spread = small.select("*", F.inline(each))
    at = micros("__at")
    bars = spread.groupBy(
        "instrument_id", "timeframe", "__w", F.timestamp_micros(at - F.pmod(at, F.col("__w"))).alias("open_time")
    ).agg(
        F.min_by("o", "__at").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"),
        F.max_by("c", "__at").alias("close"), F.sum("vb").alias("volume_base"), F.sum("vq").alias("volume_quote"),
    )
    close_time = plus("open_time", F.col("__w"))
    return bars.withColumn("close_time", close_time).withColumn("confirmed", close_time <= as_of).drop("__w")


def bar_is_valid() -> Column:
    """Finite positive prices inside the low-high range and non-negative volumes."""
    ok = F.lit(True)
    for name in ("open", "high", "low", "close", "volume_base", "volume_quote"):
        c = F.col(name)
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    for name in ("open", "high", "low", "close"):
        ok = ok & (F.col(name) > 0)
    inside = F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    return F.coalesce(ok & inside & (F.col("volume_base") >= 0) & (F.col("volume_quote") >= 0), F.lit(False))


def series_validity(bars: DataFrame) -> DataFrame:
    """Per series: bar counts, invalid bars, repeated open times and whether it may be analysed."""
    per_time = bars.groupBy(*SERIES, "open_time").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(~bar_is_valid()).alias("__bad"), F.count_if("confirmed").alias("__ok")
    )
    return per_time.groupBy(*SERIES).agg(
        F.sum("__n").alias("bars"), F.sum("__ok").alias("completed"), F.sum("__bad").alias("invalid_bars"),
        F.count_if(F.col("__n") > 1).alias("repeated_times"),
    ).withColumn(
        "usable",
        (F.col("completed") >= MIN_COMPLETED) & (F.col("invalid_bars") == 0) & (F.col("repeated_times") == 0),
    )


def numbered(bars: DataFrame, span: int = 180 * DAY) -> DataFrame:
    return number_rows(bars, SERIES, ["open_time"], bucket_of(micros("open_time"), span))


def completed_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator for every completed bar of the full history."""
    return indicators(numbered(bars.filter("confirmed")), SERIES)


def prior_high(order: WindowSpec, lookback: int = LOOKBACK) -> Column:
    """Highest completed high of the previous ``lookback`` rows, open rows counted but skipped; 0 if none."""
    frame = order.rowsBetween(-lookback, -1)
    return F.coalesce(F.max(F.when(F.col("confirmed"), F.col("high"))).over(frame), F.lit(0.0))


def is_pivot(order: WindowSpec, column: str, high: bool) -> Column:
    """Strict extreme among five completed bars."""
    here, ok = F.col(column), F.col("confirmed")
    for k in (2, 1, -1, -2):
        near = F.lag(column, k).over(order)
        ok = ok & F.coalesce(F.lag("confirmed", k).over(order), F.lit(False))
        ok = ok & (here > near if high else here < near)
    return F.coalesce(ok, F.lit(False))


def bar_features(bars: DataFrame) -> DataFrame:
    """Pivots, prior high, breakout, false breakout, moves and returns at every bar of the history."""
    rows = with_margin(numbered(bars), "idx", before=LOOKBACK + 2, after=2)
    order = Window.partitionBy(*SERIES, "__chunk").orderBy("idx")
    rows = (
        rows.withColumn("low_pivot", is_pivot(order, "low", high=False))
        .withColumn("high_pivot", is_pivot(order, "high", high=True))
        .withColumn("prior_high", prior_high(order))
        .withColumn("close_4_back", F.lag("close", 4).over(order))
    )
    before = F.lag("prior_high", 1).over(order)
    rows = (
        rows.withColumn("breakout", F.col("confirmed") & (F.col("prior_high") > 0) & (F.col("close") > F.col("prior_high")))
        .withColumn(
            "false_breakout",
            F.coalesce(
                (F.col("idx") >= LOOKBACK + 1) & (F.lag("high", 1).over(order) > before) & (F.col("close") < before),
                F.lit(False),
            ),
        )
    )
    return drop_margin(rows)


def _last(column: str | Column, position: Column, at: str = "idx") -> Column:
    """Value of the one row of a series at a position."""
    return F.max(F.when(F.col(at) == position, column if isinstance(column, Column) else F.col(column)))


def frame_readings(bars: DataFrame) -> DataFrame:
    """What an analysis needs to know of each series, one row per (instrument, timeframe).

    Indicators, pivots and prior highs come from the whole history; what an analysis reads of them
    are values at a few positions before the end, so conditional aggregates pick them and no series
    is held as a whole. Series with too few completed bars or an invalid or repeated one are left out.
    """
    rows = staged(bar_features(bars), "bar-features")
    ends = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("m"), F.max(F.when(F.col("confirmed"), F.col("idx"))).alias("end")
    )
    ends = ends.join(series_validity(bars).filter("usable").select(*SERIES), list(SERIES))
    n, m, end, idx = F.col("n"), F.col("m"), F.col("end"), F.col("idx")
    plan_before = F.when(end == n - 1, n - 1).otherwise(n)
    placed = rows.join(ends, list(SERIES))
    tail = placed.groupBy(*SERIES, "n", "m").agg(
        _last("close", n - 1).alias("latest_close"), _last("volume_quote", n - 1).alias("latest_volume"),
        _last("open_time", n - 1).alias("latest_open_time"), _last("close_time", n - 1).alias("latest_close_time"),
        _last("confirmed", n - 1).alias("latest_confirmed"), _last("close", F.greatest(F.lit(0), n - 5)).alias("close_5th"),
        _last("prior_high", n - 1).alias("latest_prior_high"), _last("prior_high", n - 2).alias("previous_prior_high"), _last("high", n - 2).alias("previous_high"),
        _last("close", end).alias("last_close"), _last("prior_high", end).alias("last_prior_high"),
        _last("close", F.greatest(F.lit(0), end - 4)).alias("close_4_before_last"), _last("close", m - 11).alias("close_10"),
        F.max(F.when(F.col("confirmed") & (idx >= plan_before - LOOKBACK) & (idx < plan_before), F.col("high"))).alias("level"),
    )
    newest = Window.partitionBy(*SERIES).orderBy(idx.desc())
    lows = rows.filter("low_pivot").withColumn("k", F.row_number().over(newest)).filter("k <= 2").groupBy(*SERIES).agg(
        (F.max(F.when(F.col("k") == 1, F.col("low"))) > F.max(F.when(F.col("k") == 2, F.col("low")))).alias("higher_low")
    )
    done = completed_indicators(bars).join(ends.select(*SERIES, "m"), list(SERIES))
    volumes = F.sort_array(F.collect_list(F.when(idx >= m - LOOKBACK, F.col("volume_quote"))))  # LOOKBACK values
    read = done.groupBy(*SERIES).agg(
        _last("close", m - 5).alias("completed_close_4"), volumes.alias("v"), _last("ema20", m - 1).alias("ema20"), _last("ema50", m - 1).alias("ema50"),
        _last("rsi14", m - 1).alias("rsi14"), _last("macd_histogram", m - 1).alias("macd_histogram"), _last("atr14", m - 1).alias("atr14"),
        _last("macd_histogram", m - 2).alias("histogram_1"), _last("macd_histogram", m - 3).alias("histogram_2"), _last("rsi14", m - 11).alias("rsi_10"),
        F.coalesce(F.bool_or(F.when((idx >= m - LOOKBACK) & (idx < m - 1), F.col("rsi14").between(35.0, 45.0))), F.lit(False)).alias("rsi_was_low"),
    )
    both = tail.join(read, list(SERIES)).join(lows, list(SERIES), "left")
    return both.select(
        *SERIES, n.cast("int").alias("bars"), m.cast("int").alias("completed"), "latest_close", "latest_volume", "latest_open_time", "latest_close_time",
        "latest_confirmed", "close_5th", "latest_prior_high", "previous_prior_high", "previous_high", "last_close", "last_prior_high",
        "close_4_before_last", "completed_close_4",
        ((F.get("v", F.lit(LOOKBACK // 2 - 1)) + F.get("v", F.lit(LOOKBACK // 2))) / 2).alias("volume_median20"),
        "ema20", "ema50", "rsi14", "macd_histogram", "atr14", "histogram_1", "histogram_2", "rsi_10", "close_10", "rsi_was_low",
        F.when(F.col("level") > 0, F.col("level")).alias("confirmation_level"), F.coalesce("higher_low", F.lit(False)).alias("higher_low"),
    )


def completed_return(reading: Column) -> Column:
    """Percent change over the last four completed periods; 0 for a short history."""
    base = reading["completed_close_4"]
    return F.when(base > 0, (reading["last_close"] / base - 1) * 100).otherwise(F.lit(0.0))


def level_pivots(bars: DataFrame, timeframe: str = "4H", last: int = PLAN_BARS) -> DataFrame:
    """Pivots inside the newest ``last`` bars of one frame, which the plan looks at; one row per pivot."""
    newest = Window.partitionBy(*SERIES).orderBy(F.col("open_time").desc())
    rows = bars.filter(F.col("timeframe") == timeframe).withColumn("rn", F.row_number().over(newest))
    # The filter is on the row number itself, so each input partition is cut to ``last`` rows before the exchange.
    rows = rows.filter(F.col("rn") <= last).withColumn("idx", -F.col("rn")).drop("rn")
    order = Window.partitionBy(*SERIES).orderBy("idx")
    kinds = F.array_compact(
        F.array(
            F.when(is_pivot(order, "low", high=False), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))),
            F.when(is_pivot(order, "high", high=True), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        )
    )
    return rows.withColumn("__k", kinds).select("instrument_id", "idx", F.inline("__k"))


def recent_returns(bars: DataFrame, timeframe: str = "1H", periods: int = 4) -> DataFrame:
    """Percent change over the last ``periods`` completed bars per instrument; 0 when the history is short."""
    newest = Window.partitionBy("instrument_id").orderBy(F.col("open_time").desc())
    tail = (
        bars.filter((F.col("timeframe") == timeframe) & F.col("confirmed"))
        .withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= periods + 1)
    )
    ends = tail.groupBy("instrument_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("last"),
        F.max(F.when(F.col("rn") == periods + 1, F.col("close"))).alias("base"),
    )
    change = F.when(F.col("base") > 0, (F.col("last") / F.col("base") - 1) * 100).otherwise(F.lit(0.0))
    return ends.select("instrument_id", change.alias("recent_return"))
