"""Recursive smoothers (EMA, Wilder averages, MACD) over arbitrarily long series.

``y[i] = a * x[i] + (1 - a) * y[i-1]`` is linear, so a series is cut into chunks: inside a chunk a
window sum of decay-weighted inputs gives the smoothed value for a zero start, and the start
value reaches a chunk through one small state row per chunk. The seed, the mean of the first
``period`` inputs, enters as a single impulse. Positions before the seed hold 0.0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.joins import previous_row
from tidemark.operators.series import CHUNK, drop_margin, with_margin
from tidemark.session import staged

RSI_PERIOD = 14
ATR_PERIOD = 14
EMA_PERIODS = (20, 50, 200)
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9


@dataclass(frozen=True)
class Smoother:
    """One recursive average: input column, weight, seed length and first valid input position."""

    out: str
    value: str
    alpha: float
    period: int
    start: int = 0

    @property
    def seed_at(self) -> int:
        return self.start + self.period - 1


def ema_of(out: str, value: str, period: int, start: int = 0) -> Smoother:
    return Smoother(out, value, 2.0 / (period + 1), period, start)


def wilder_of(out: str, value: str, period: int, start: int = 0) -> Smoother:
    return Smoother(out, value, 1.0 / period, period, start)


def smooth(df: DataFrame, on: Sequence[str], idx: str, specs: Sequence[Smoother], chunk: int = CHUNK) -> DataFrame:
    """Add one column per smoother; ``idx`` is the dense zero-based position in the series."""
    on = list(on)
    if any(s.seed_at >= chunk for s in specs):
        raise ValueError("a seed must lie inside the first chunk")
    pos = F.pmod(F.col(idx), F.lit(chunk)).cast("double")
    work = df.withColumn("__chunk", F.floor(F.col(idx) / chunk).cast("bigint"))
    running = Window.partitionBy(*on, "__chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    pushes = {}
    for s in specs:
        # The seed lies in the first chunk, so its mean is a running sum there: linear work.
        seed = F.sum(F.when(F.col(idx).between(s.start, s.seed_at), F.col(s.value))).over(running) / s.period
        pushes[f"__in_{s.out}"] = (
            F.when(F.col(idx) > s.seed_at, F.col(s.value) * s.alpha)
            .when(F.col(idx) == s.seed_at, seed)
            .otherwise(F.lit(0.0))
        )
    work = work.withColumns(pushes)
    ends = work.groupBy(*on, "__chunk").agg(
        *[
            F.sum(F.col(f"__in_{s.out}") * F.pow(F.lit(1.0 - s.alpha), F.lit(chunk - 1.0) - pos)).alias(f"__e_{s.out}")
            for s in specs
        ]
    )
    states = _chunk_starts(ends, on, specs, chunk)
    joined = work.join(states, [*on, "__chunk"], "left")
    smoothed = {}
    for s in specs:
        keep = F.lit(1.0 - s.alpha)
        local = F.pow(keep, pos) * F.sum(F.col(f"__in_{s.out}") * F.pow(keep, -pos)).over(running)
        carried = F.pow(keep, pos + 1.0) * F.coalesce(F.col(f"__s_{s.out}"), F.lit(0.0))
        smoothed[s.out] = F.when(F.col(idx) >= s.seed_at, local + carried).otherwise(F.lit(0.0))
    return joined.withColumns(smoothed).drop("__chunk", *[f"__in_{s.out}" for s in specs], *[f"__s_{s.out}" for s in specs])


#: What is left of a value after this many halvings is far below the rounding of any sum it is added to.
FORGOTTEN = 200.0


def _chunk_starts(ends: DataFrame, on: list[str], specs: Sequence[Smoother], chunk: int) -> DataFrame:
    """Smoothed value each chunk starts from: a parallel prefix over the affine maps of the chunks, level by level.

    A chunk maps the value it starts from to ``end + keep ** chunk * value``. A level joins every chunk
    with the one 1, 2, 4, ... places before, which doubles the span its map covers; chunks further back
    than ``FORGOTTEN`` halvings no longer count. Chunks lie in blocks that carry along as many chunks
    of the block before as that takes, so no window is as long as a series.
    """
    decay = {s.out: math.log2(1.0 - s.alpha) * chunk for s in specs}  # negative: powers of two per chunk
    reach = {out: max(1, math.ceil(FORGOTTEN / -d)) for out, d in decay.items()}
    margin = 1 << (max(reach.values()) - 1).bit_length()
    block = max(chunk, 2 * margin)
    rows = with_margin(ends.withColumnRenamed("__chunk", "__at"), "__at", before=margin, after=0, chunk=block)
    order = Window.partitionBy(*on, "__chunk").orderBy("__at")
    span = 1
    while span < margin:
        # Places, not rows, are what a level looks back by; chunks have no gaps, as positions are dense.
        joined = {
            f"__e_{s.out}": F.col(f"__e_{s.out}") + F.lit(2.0 ** max(decay[s.out] * span, -1074.0)) * F.coalesce(F.lag(f"__e_{s.out}", span).over(order), F.lit(0.0))
            for s in specs if span < reach[s.out]
        }
        rows, span = rows.withColumns(joined), 2 * span
    return drop_margin(rows).select(*on, (F.col("__at") + 1).alias("__chunk"), *[F.col(f"__e_{s.out}").alias(f"__s_{s.out}") for s in specs])


def rsi_from(gain: Column, loss: Column) -> Column:
    """Flat gives 50, no losses 100, no gains 0."""
    return (
        F.when((gain == 0) & (loss == 0), F.lit(50.0))
        .when(loss == 0, F.lit(100.0))
        .when(gain == 0, F.lit(0.0))
        .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss))
    )


def indicators(bars: DataFrame, on: Sequence[str], idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """EMA20/50/200, RSI14, MACD 12/26/9 and ATR14 for every completed bar of every series.

    Expects completed bars numbered 0..n-1 by ``idx`` with high, low and close. Rows are staged
    before each smoothing pass: a pass reads its rows twice, and nesting would multiply the scans.
    """
    on = list(on)
    home = F.floor(F.col(idx) / chunk).cast("bigint")
    work = previous_row(bars, on, [idx], ["close"], home, "__prev")
    change = F.col("close") - F.col("__prev.close")
    tr = F.col("high") - F.col("low")
    work = (
        work.withColumn("__gain", F.when(change > 0, change).otherwise(F.lit(0.0)))
        .withColumn("__loss", F.when(change < 0, -change).otherwise(F.lit(0.0)))
        .withColumn(
            "__tr",
            F.when(
                F.col("__prev").isNotNull(),
                F.greatest(
                    tr, F.abs(F.col("high") - F.col("__prev.close")), F.abs(F.col("low") - F.col("__prev.close"))
                ),
            ).otherwise(tr),
        )
    )
    work = staged(work, "indicator-inputs")
    specs = [ema_of(f"ema{p}", "close", p) for p in EMA_PERIODS]
    specs += [ema_of("__fast", "close", MACD_FAST), ema_of("__slow", "close", MACD_SLOW)]
    specs += [
        wilder_of("__ag", "__gain", RSI_PERIOD, start=1),
        wilder_of("__al", "__loss", RSI_PERIOD, start=1),
        wilder_of("atr14", "__tr", ATR_PERIOD),
    ]
    work = smooth(work, on, idx, specs, chunk)
    line_from = MACD_SLOW - 1
    signal_at = line_from + MACD_SIGNAL - 1
    work = work.withColumn(
        "rsi14",
        F.when(F.col(idx) >= RSI_PERIOD, rsi_from(F.col("__ag"), F.col("__al"))).otherwise(F.lit(0.0)),
    ).withColumn("macd", F.when(F.col(idx) >= line_from, F.col("__fast") - F.col("__slow")).otherwise(F.lit(0.0)))
    work = staged(work, "indicator-lines")
    work = smooth(work, on, idx, [ema_of("macd_signal", "macd", MACD_SIGNAL, start=line_from)], chunk)
    work = work.withColumn(
        "macd_histogram",
        F.when(F.col(idx) >= signal_at, F.col("macd") - F.col("macd_signal")).otherwise(F.lit(0.0)),
    )
    return work.drop("__prev", "__gain", "__loss", "__tr", "__fast", "__slow", "__ag", "__al")
