"""Start score, trend evidence, stages and staged price plans for instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import quality as q
from tidemark.functions.timecol import SECOND, micros
from tidemark.operators.bars import completed_return

# Score bounds, shares of the plan and its limits.
CROWDED_FUNDING = 0.0005
HIGH_VOLATILITY_ATR = 0.08
HIGH_VOLATILITY_CHANGE = 15.0
SLACK = 1e-9
ENTRY_WEIGHTS = (0.30, 0.25, 0.25)
CONFIRMATION_WEIGHT = 0.20
MAX_RISK_PCT = 15.0
MIN_REWARD_RISK = 1.3
TOP_PER_RUN = 10
EXECUTION, REVERSAL, TREND, REGIME = "15m", "1H", "4H", "1Dutc"


def frames_side_by_side(readings: DataFrame) -> DataFrame:
    """One row per instrument holding all four frames; incomplete instruments are left out."""
    names = [c for c in readings.columns if c not in ("instrument_id", "timeframe")]
    pack = F.struct(*names)
    wide = readings.groupBy("instrument_id").agg(
        *[F.max_by(pack, F.when(F.col("timeframe") == f, 1)).alias(f"f{f}") for f in (EXECUTION, REVERSAL, TREND, REGIME)]
    )
    ok = F.lit(True)
    for f in (EXECUTION, REVERSAL, TREND, REGIME):
        ok = ok & F.col(f"f{f}").isNotNull()
    return wide.filter(ok)


def normalized_volume_ratio(frame: Column, as_of: Column) -> Column:
    """Volume over its 20-bar median; an open bar is scaled by its progress and capped at three medians."""
    median = frame["volume_median20"]
    opened, closes = micros(frame["latest_open_time"]), micros(frame["latest_close_time"])
    share = (micros(as_of) - opened) / (closes - opened)
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.1), share))
    scaled = F.least(frame["latest_volume"] / progress, median * 3)
    volume = F.when(frame["latest_confirmed"], frame["latest_volume"]).otherwise(scaled)
    return F.when(median > 0, volume / median).otherwise(F.lit(0.0))


def price_acceleration(move15: Column, atr15: Column, move60: Column, atr60: Column) -> Column:
    fast, slow = q.divide(move15, atr15), q.divide(move60, atr60)
    return (
        F.when((atr15 <= 0) | (atr60 <= 0), 0)
        .when((fast >= 1) & (slow >= 1), 25)
        .when(((fast >= 1) & (slow >= 0.25)) | ((slow >= 1) & (fast > 0)), 18)
        .when((fast > 0) & (slow > 0), 12)
        .otherwise(0)
    )


def _points(flag: Column, points: int) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), points).otherwise(0)


def evidence(df: DataFrame, as_of: Column) -> DataFrame:
    """Signals read from the frames. Expects the frame structs plus funding_rate, oi_change_15m,
    oi_change_1h, change_24h_pct, benchmark_return and pool_median_return."""
    ex, rv, tr, rg = (F.col(f"f{f}") for f in (EXECUTION, REVERSAL, TREND, REGIME))
    closed_break = (ex["last_prior_high"] > 0) & (ex["last_close"] > ex["last_prior_high"])
    live_break = (ex["latest_prior_high"] > 0) & (ex["latest_close"] > ex["latest_prior_high"])
    flip = (rv["histogram_2"] < rv["histogram_1"]) & (rv["histogram_1"] <= 0) & (rv["macd_histogram"] > 0)
    out = df.withColumns(
        {
            "volume_ratio": normalized_volume_ratio(ex, as_of),
            "price_move": ex["latest_close"] - ex["close_5th"],
            "completed_breakout": F.coalesce(closed_break, F.lit(False)),
            "breakout": F.coalesce(closed_break | live_break, F.lit(False)),
            "false_breakout": F.coalesce(
                (ex["bars"] >= 22) & (ex["previous_high"] > ex["previous_prior_high"])
                & (ex["latest_close"] < ex["previous_prior_high"]),
                F.lit(False),
            ),
            "bearish_divergence": F.coalesce(
                (ex["last_close"] > ex["close_10"]) & (ex["rsi14"] < ex["rsi_10"]), F.lit(False)
            ),
            "crowded_funding": F.coalesce(F.col("funding_rate") >= CROWDED_FUNDING, F.lit(False)),
            "asset_return": completed_return(rv),
            "rsi_recovered": F.coalesce((rv["rsi14"] > 50) & rv["rsi_was_low"], F.lit(False)),
            "macd_flip": F.coalesce(flip, F.lit(False)),
            "current_price": ex["latest_close"],
        }
    )
    oi_up = F.coalesce(F.col("oi_change_1h") > 0, F.lit(False))
    return out.withColumn("higher_low", rv["higher_low"] & ((F.col("volume_ratio") >= 1.2) | oi_up))


def score_opportunities(df: DataFrame) -> DataFrame:
    """Start score with penalties, evidence per frame, quality score, volatility flag and stage."""
    ex, rv, tr, rg = (F.col(f"f{f}") for f in (EXECUTION, REVERSAL, TREND, REGIME))
    c = F.col
    volume = q.ladder(c("volume_ratio"), ((2.0, 25), (1.5, 18), (1.2, 10))).cast("int")
    above_ema = ex["latest_close"] > ex["ema20"]
    up = c("price_move") > 0
    work = df.withColumns(
        {
            "price_points": price_acceleration(
                c("price_move"), ex["atr14"], rv["last_close"] - rv["close_4_before_last"], rv["atr14"]
            ),
            "volume_points": volume,
            "breakout_points": F.when(c("breakout"), 20).when(above_ema, 10).otherwise(0),
            "oi_points": F.when((c("oi_change_15m") > 0) & up, 15).when((c("oi_change_1h") > 0) & up, 10).otherwise(0),
            "relative_points": F.when(
                (c("asset_return") > c("benchmark_return")) & (c("asset_return") > c("pool_median_return")), 15
            ).when(c("asset_return") > 0, 7).otherwise(0),
            "risk_divergence": (ex["rsi14"] > 80) & c("bearish_divergence"),
            "risk_extended": (ex["atr14"] > 0) & (ex["latest_close"] - ex["ema20"] > 2 * ex["atr14"]),
        }
    )
    gain = c("price_points") + c("volume_points") + c("breakout_points") + c("oi_points") + c("relative_points")
    cost = (
        _points(c("risk_divergence"), 10) + _points(c("risk_extended"), 10) + _points(c("crowded_funding"), 5)
        + _points(c("false_breakout"), 10)
    )
    strengthening = rg["macd_histogram"] >= rg["histogram_1"]
    checks = _points(c("rsi_recovered"), 1) + _points(c("macd_flip"), 1) + _points(c("higher_low"), 1)
    work = work.withColumns(
        {
            "start_score": F.least(F.lit(100), F.greatest(F.lit(0), gain - cost)),
            "daily_score": F.when(
                (rg["last_close"] > rg["ema20"]) & (rg["last_close"] > rg["ema50"]) & strengthening, 15
            ).when(rg["last_close"] > F.least(rg["ema20"], rg["ema50"]), 8).otherwise(0),
            "trend_score": 5 + _points(tr["last_close"] > tr["ema20"], 10) + _points(tr["ema20"] > tr["ema50"], 10),
            "reversal_checks": checks,
            "execution_score": F.when(c("completed_breakout"), 20).when(c("breakout"), 10).otherwise(5),
            "derivatives_score": _points(c("volume_ratio") >= 1.2, 5) + _points(c("oi_change_15m") > 0, 5)
            + _points(~c("crowded_funding"), 5),
            "high_volatility": F.coalesce(
                ((rg["last_close"] > 0) & (q.divide(rg["atr14"], rg["last_close"]) >= HIGH_VOLATILITY_ATR))
                | (F.abs(c("change_24h_pct")) >= HIGH_VOLATILITY_CHANGE),
                F.lit(False),
            ),
            "overheated": (ex["rsi14"] > 80)
            & (c("risk_divergence") | (c("volume_ratio") < 1) | c("crowded_funding")),
        }
    )
    work = work.withColumn(
        "reversal_score", F.when(c("reversal_checks") >= 2, 25).when(c("reversal_checks") == 1, 12).otherwise(0)
    ).withColumn("reversal_confirmed", c("reversal_checks") >= 2).withColumn("long_allowed", c("daily_score") > 0)
    work = work.withColumn(
        "opportunity_score",
        c("daily_score") + c("trend_score") + c("reversal_score") + c("execution_score") + c("derivatives_score"),
    )
    work = with_stage(work)
    risks = F.array_sort(
        F.array_compact(
            F.array(
                F.when(c("risk_divergence"), "BEARISH_DIVERGENCE"), F.when(c("risk_extended"), "EXTENDED_ABOVE_EMA20"),
                F.when(c("crowded_funding"), "CROWDED_FUNDING"), F.when(c("false_breakout"), "FALSE_BREAKOUT"),
                F.when(c("vetoed"), "DAILY_VETO"),
            )
        )
    )
    return work.withColumn("risk_flags", risks).drop("vetoed")


def with_stage(df: DataFrame) -> DataFrame:
    """``stage`` from the start score and the confirmations; ``vetoed`` tells that the daily regime held it back."""
    c, score = F.col, F.col("start_score")
    both = c("reversal_confirmed") & ~c("false_breakout") & c("completed_breakout")
    natural = (
        F.when(score < 50, "NONE").when(c("overheated"), "OVERHEATED").when(score < 65, "PRELAUNCH")
        .when((score >= 90) & both, "ACCELERATING").when((score >= 80) & both, "CONFIRMED").otherwise("STARTING")
    )
    staged_as = df.withColumn("__natural", natural).withColumn("vetoed", ~c("long_allowed") & ~c("__natural").isin("NONE", "PRELAUNCH"))
    return staged_as.withColumn("stage", F.when(c("vetoed"), "PRELAUNCH").otherwise(c("__natural"))).drop("__natural")


def visible(opportunities: DataFrame) -> DataFrame:
    return opportunities.filter(F.col("stage") != "NONE")


def oi_change(current: Column, baseline: Column) -> Column:
    """Percent change of open interest; NULL when either side is missing or not positive."""
    return F.when((current > 0) & (baseline > 0), (current / baseline - 1) * 100)


# ---- price plan -----------------------------------------------------------------------------


def cluster_levels(pivots: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Zones of sorted prices, a new one where the step from the price below exceeds ``gap``.

    A key holds the pivots of at most sixty bars plus two averages.
    """
    order = Window.partitionBy(*keys).orderBy("price")
    step = F.col("price") - F.lag("price").over(order)
    marked = pivots.withColumn("__new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    zoned = marked.withColumn("zone", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return zoned.groupBy(*keys, "zone").agg(
        F.min("price").alias("zone_low"), F.max("price").alias("zone_high"), F.count(F.lit(1)).alias("strength")
    )


def with_levels(opportunities: DataFrame, pivots: DataFrame) -> DataFrame:
    """Attach the nearest support zone and the two nearest resistance zones.

    Lows join the trend averages below the price; both kinds cluster within half an ATR.
    """
    trend = F.col(f"f{TREND}")
    base = opportunities.filter(trend["atr14"] > 0).select(
        "instrument_id", "current_price", trend["atr14"].alias("atr"), trend["ema20"].alias("a"), trend["ema50"].alias("b")
    )
    averages = base.select(
        "instrument_id", "current_price", "atr", F.explode(F.array("a", "b")).alias("price")
    ).filter((F.col("price") > 0) & (F.col("price") < F.col("current_price"))).withColumn("kind", F.lit("low"))
    found = base.join(pivots.filter(F.col("price") > 0), "instrument_id").select(
        "instrument_id", "current_price", "atr", "price", "kind"
    )
    zones = cluster_levels(
        found.unionByName(averages), ["instrument_id", "kind", "current_price", "atr"], F.col("atr") * 0.5
    )
    below = (F.col("kind") == "low") & (F.col("zone_high") < F.col("current_price"))
    above = (F.col("kind") == "high") & (F.col("zone_low") > F.col("current_price"))
    zone = F.struct(F.col("zone_low").alias("low"), F.col("zone_high").alias("high"), "strength")
    levels = zones.groupBy("instrument_id").agg(
        F.max_by(zone, F.when(below, F.col("zone_high"))).alias("support"),
        F.array_sort(F.collect_list(F.when(above, zone))).alias("resistances"),
    )
    return opportunities.join(levels, "instrument_id", "left")


def clean_tick(price: Column, tick: Column) -> Column:
    digits = F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(-F.log10(tick)).cast("int") + 2))
    scale = F.pow(F.lit(10.0), digits)
    scaled = price * scale
    return F.when(tick > 0, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / scale)


def round_down_tick(price: Column, tick: Column) -> Column:
    return clean_tick(F.floor(q.divide(price, tick) + 1e-10) * tick, tick)


def round_up_tick(price: Column, tick: Column) -> Column:
    return clean_tick(F.ceil(q.divide(price, tick) - 1e-10) * tick, tick)


def price_plan(df: DataFrame) -> DataFrame:
    """Staged entries, stop and two targets, or a rejection code in ``plan_rejection``.

    Expects start_score, high_volatility, long_allowed, current_price, tick_size, support,
    resistances and confirmation_level.
    """
    c = F.col
    atr = c(f"f{TREND}")["atr14"]
    low, high0 = c("support")["low"], c("support")["high"]
    high = F.when((atr * 0.5 > 0) & (high0 - low < atr * 0.5), low + atr * 0.5).otherwise(high0)
    tick = c("tick_size")
    confirm = F.when(F.coalesce(c("confirmation_level"), F.lit(0.0)) <= high0, c("current_price")).otherwise(
        c("confirmation_level")
    )
    first_res, second_res = F.get(c("resistances"), F.lit(0)), F.get(c("resistances"), F.lit(1))
    work = df.withColumns(
        {
            "__low": low, "__high": high, "__atr": atr,
            "entry_1": round_down_tick(high, tick), "entry_2": round_down_tick((low + high) / 2, tick),
            "entry_3": round_down_tick(low, tick), "confirmation_entry": round_up_tick(confirm, tick),
            "stop_price": round_down_tick(low - atr * 0.5, tick),
            "target_1": round_up_tick(first_res["low"], tick), "__second": second_res["low"],
        }
    )
    left = c("entry_1") * ENTRY_WEIGHTS[0] + c("entry_2") * ENTRY_WEIGHTS[1] + c("entry_3") * ENTRY_WEIGHTS[2]
    work = work.withColumn("left_average_cost", left / 0.80).withColumn(
        "full_average_cost", left + c("confirmation_entry") * CONFIRMATION_WEIGHT
    )
    work = work.withColumn("__risk", c("full_average_cost") - c("stop_price"))
    work = work.withColumn("risk_pct", q.divide(c("__risk"), c("full_average_cost")) * 100).withColumn(
        "reward_risk_1", q.divide(c("target_1") - c("full_average_cost"), c("__risk"))
    )
    doubled = round_up_tick(c("full_average_cost") + 2 * c("__risk"), tick)
    second = F.when(c("__second") > c("target_1"), round_up_tick(c("__second"), tick)).otherwise(doubled)
    work = work.withColumn(
        "target_2", F.when(second <= c("target_1"), round_up_tick(c("target_1") + c("__risk"), tick)).otherwise(second)
    ).withColumn("reward_risk_2", q.divide(c("target_2") - c("full_average_cost"), c("__risk")))
    need = F.when(c("high_volatility"), 70).otherwise(65)
    no = lambda test: ~F.coalesce(test, F.lit(False))
    reason = (
        F.when(no(c("long_allowed")), "daily_veto")
        .when(no(c("__atr") > 0), "no_atr")
        .when(c("support").isNull(), "no_support")
        .when(c("start_score") < need, "low_score")
        .when(no(tick > 0), "bad_tick")
        .when(no((c("__low") > 0) & (c("__high") < c("current_price"))), "support_not_below_price")
        .when(F.coalesce(F.size("resistances"), F.lit(0)) <= 0, "no_resistance")
        .when(no((c("entry_1") > c("entry_2")) & (c("entry_2") > c("entry_3"))), "entries_collapse")
        .when(no((c("entry_3") > 0) & (c("confirmation_entry") > 0)), "entry_not_positive")
        .when(no((c("stop_price") > 0) & (c("stop_price") < c("full_average_cost"))), "bad_stop")
        .when(c("risk_pct") > MAX_RISK_PCT + SLACK, "risk_too_high")
        .when(
            no((c("target_1") > c("full_average_cost")) & (c("target_1") > c("current_price"))), "target_not_above"
        )
        .when(c("reward_risk_1") < MIN_REWARD_RISK - SLACK, "reward_too_low")
    )
    work = work.withColumn("plan_rejection", reason)
    keep = [
        "entry_1", "entry_2", "entry_3", "confirmation_entry", "left_average_cost", "full_average_cost", "stop_price",
        "risk_pct", "target_1", "target_2", "reward_risk_1", "reward_risk_2",
    ]
    for name in keep:
        work = work.withColumn(name, F.when(c("plan_rejection").isNull(), c(name)))
    return work.withColumn("high_risk", c("risk_pct") > 10).drop(*[x for x in work.columns if x.startswith("__")])


def top_opportunities(df: DataFrame, keys: list[str], n: int = TOP_PER_RUN) -> DataFrame:
    """Best ``n`` per run by quality, start score and id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(
        F.col("opportunity_score").desc(), F.col("start_score").desc(), F.col("instrument_id")
    )
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def run_status(analysed: Column, warnings: Column) -> Column:
    return F.when(warnings == 0, "completed").when(analysed > 0, "degraded").otherwise("failed")
