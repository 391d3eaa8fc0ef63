"""From bars and derivatives snapshots to ranked opportunities with price plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timecol import DAY, HOUR, MINUTE, micros
from tidemark.operators import bars as br, opportunity as op
from tidemark.operators.joins import asof_instants
from tidemark.operators.order_stats import grouped_median
from tidemark.session import staged


def latest_derivatives(derivatives: DataFrame) -> DataFrame:
    """Newest snapshot per instrument, reduced map-side."""
    cols = [c for c in derivatives.columns if c != "instrument_id"]
    return derivatives.groupBy("instrument_id").agg(
        F.max_by(F.struct(*cols), F.struct("collected_at", "id")).alias("s")
    ).select("instrument_id", "s.*")


def oi_changes(
    current: DataFrame, history: DataFrame, short: int = 15 * MINUTE, long: int = HOUR, bucket: int = DAY
) -> DataFrame:
    """Open-interest change against the newest snapshot at or before two look-back instants, in one pass over the history."""
    names = {"oi_change_15m": short, "oi_change_1h": long}
    instants = {f"__{name}": F.timestamp_micros(micros("collected_at") - back) for name, back in names.items()}
    out = asof_instants(current, history, ["asset_class", "instrument_id"], instants, "collected_at", ["open_interest_usd"], "id", bucket=bucket)
    for name in names:
        out = out.withColumn(name, op.oi_change(F.col("open_interest_usd"), F.col(f"__{name}.open_interest_usd")))
    return out.drop(*instants)


def pool_context(bars: DataFrame, assets: DataFrame, benchmarks: dict[str, str]) -> DataFrame:
    """Benchmark return and pool median return per asset class: one row per class."""
    returns = br.recent_returns(bars, op.REVERSAL).join(assets.select("instrument_id", "asset_class"), "instrument_id")
    returns = staged(returns, "pool-returns")
    median = grouped_median(returns, ["asset_class"], "recent_return", "pool_median_return")
    wanted = F.lit(False)
    for cls, instrument in benchmarks.items():
        wanted = wanted | ((F.col("asset_class") == cls) & (F.col("instrument_id") == instrument))
    bench = returns.filter(wanted).groupBy("asset_class").agg(F.max("recent_return").alias("benchmark_return"))
    return median.join(bench, "asset_class", "inner")


def scan(bars: DataFrame, assets: DataFrame, as_of: Column, benchmarks: dict[str, str]) -> DataFrame:
    """Score every asset of the pool. ``assets`` carries class, change, funding, OI changes and tick size."""
    assets = staged(assets, "scan-assets")
    wide = op.frames_side_by_side(br.frame_readings(bars))
    context = pool_context(bars, assets, benchmarks)
    joined = wide.join(assets, "instrument_id").join(context, "asset_class")
    return op.score_opportunities(op.evidence(joined, as_of))


def with_plans(scored: DataFrame, bars: DataFrame) -> DataFrame:
    """Attach levels and the staged plan to visible opportunities, a handful of rows per scan."""
    shown = staged(op.visible(scored), "visible-opportunities")
    levelled = op.with_levels(shown, br.level_pivots(bars, op.TREND))
    levelled = levelled.withColumn("confirmation_level", F.col(f"f{op.EXECUTION}")["confirmation_level"])
    return op.price_plan(levelled)
