"""What happened after each signal: first crossings, paper entries, horizon outcomes, statistics.

Nothing here looks past the study's watermark, and a window only closes when the newest observed
time has moved beyond its end, never because the clock did.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timecol import HOUR, MINUTE, micros, plus, whole_seconds
from tidemark.operators.joins import interval_join
from tidemark.operators.order_stats import grouped_median

# Score thresholds, horizons with tolerance, statistic scopes.
THRESHOLDS = (55, 60, 65, 70, 75, 80, 85, 90)


@dataclass(frozen=True)
class Horizon:
    key: str
    offset: int
    tolerance: int


HORIZONS = (
    Horizon("5m", 5 * MINUTE, 3 * MINUTE), Horizon("15m", 15 * MINUTE, 3 * MINUTE),
    Horizon("30m", 30 * MINUTE, 3 * MINUTE), Horizon("1h", HOUR, 10 * MINUTE), Horizon("3h", 3 * HOUR, 10 * MINUTE),
    Horizon("6h", 6 * HOUR, 10 * MINUTE), Horizon("24h", 24 * HOUR, HOUR),
)
SOURCE_SCOPES = ("BACKFILL", "LIVE", "ALL")
CHAIN_SCOPES = ("BSC", "SOLANA", "ALL")
EVIDENCE_SCOPES = ("HIGH_GOOD", "MEDIUM_LOW", "UNKNOWN", "ALL")
MIN_SAMPLE = 20
SIGNAL_KEY = ("token_id", "score_version", "threshold")
CELL_KEY = ("signal_source_scope", "chain_scope", "evidence_scope", "score_version", "threshold", "horizon")
FIELDS = ("id", "collected_at", "chain", "price_usd", "raw_score", "evidence_confidence")


def frontier(snapshots: DataFrame) -> DataFrame:
    """One row: the highest snapshot id and the newest observed time up to it."""
    return snapshots.agg(
        F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("high_watermark"), F.max("collected_at").alias("observed_at")
    )


def first_crossings(scores: DataFrame, activation_id: Column | int, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Lowest snapshot id reaching each threshold per (token, version), at most one signal ever.

    All thresholds share one partially aggregated pass; rows are never multiplied per threshold.
    """
    # Only ids are aggregated, in hash tables; the few rows they name are then looked up.
    first = [F.min(F.when(F.col("raw_score") >= t, F.col("id"))).alias(f"__t{t}") for t in thresholds]
    high = scores.filter(F.col("raw_score") >= min(thresholds))
    found = high.groupBy("token_id", "score_version").agg(*first)
    each = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"__t{t}").alias("id")) for t in thresholds])
    named = found.select("token_id", "score_version", F.inline(each)).filter(F.col("id").isNotNull())
    rows = high.select("token_id", "score_version", *FIELDS).join(named, ["token_id", "score_version", "id"]).dropDuplicates(list(SIGNAL_KEY))
    live = F.col("id") > (activation_id if isinstance(activation_id, Column) else F.lit(activation_id))
    return rows.select(
        *SIGNAL_KEY, "chain", F.when(live, "LIVE").otherwise("BACKFILL").alias("signal_source"), F.col("id").alias("signal_snapshot_id"),
        F.col("collected_at").alias("signal_at"), "price_usd", "raw_score", "evidence_confidence",
    )


def new_signals(crossings: DataFrame, existing: DataFrame) -> DataFrame:
    """Crossings whose key has no signal yet."""
    return crossings.join(existing.select(*SIGNAL_KEY), list(SIGNAL_KEY), "left_anti")


def paper_entries(signals: DataFrame) -> DataFrame:
    """Enter at the signal's own snapshot when it carries a positive price."""
    ok = F.coalesce(F.col("price_usd") > 0, F.lit(False))
    return signals.withColumn("entry_status", F.when(ok, "EVALUABLE").otherwise("UNAVAILABLE_PRICE")).withColumn(
        "entry_price_usd", F.when(ok, F.col("price_usd"))
    )


def horizon_array(horizons: Sequence[Horizon]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(h.key).alias("horizon"), F.lit(h.offset).alias("offset_us"), F.lit(h.tolerance).alias("tolerance_us")
            )
            for h in horizons
        ]
    )


def expand_horizons(entries: DataFrame, horizons: Sequence[Horizon] = HORIZONS) -> DataFrame:
    """One pending (or not evaluable) outcome per entry and horizon."""
    spread = entries.select("*", F.inline(horizon_array(horizons)))
    target = plus("signal_at", F.col("offset_us"))
    return (
        spread.withColumn("target_at", target)
        .withColumn("window_end_at", plus("signal_at", F.col("offset_us") + F.col("tolerance_us")))
        .withColumn("status", F.when(F.col("entry_status") == "EVALUABLE", "PENDING").otherwise("NOT_EVALUABLE"))
        .drop("offset_us", "tolerance_us")
    )


def price_observations(snapshots: DataFrame, high_watermark: Column) -> DataFrame:
    """Valid prices up to the watermark."""
    return snapshots.filter((F.col("price_usd") > 0) & (F.col("id") <= high_watermark)).select(
        "token_id", F.col("id").alias("obs_id"), F.col("collected_at").alias("obs_at"), F.col("price_usd").alias("obs_price")
    )


def observe_horizons(
    entries: DataFrame, prices: DataFrame, horizons: Sequence[Horizon] = HORIZONS, bucket: int = HOUR
) -> DataFrame:
    """Selected price and path extremes for every evaluable entry and horizon.

    One range join per entry serves all horizons. The selected row is the first valid price in
    the window, so the path up to it is everything before the target plus the rows at the
    selected instant; both reduce with partial aggregates and no path is ever materialised.
    """
    last = max(h.offset + h.tolerance for h in horizons)
    base = entries.filter(F.col("entry_status") == "EVALUABLE").select(
        *SIGNAL_KEY, "signal_snapshot_id", "signal_at", "entry_price_usd", plus("signal_at", last).alias("last_at")
    )
    after = (F.col("obs_at") > F.col("signal_at")) & (F.col("obs_id") > F.col("signal_snapshot_id"))
    pairs = interval_join(base, prices, ["token_id"], "signal_at", "last_at", "obs_at", after, bucket)
    age = micros("obs_at") - micros("signal_at")
    aggs = []
    for i, h in enumerate(horizons):
        inside = (age >= h.offset) & (age <= h.offset + h.tolerance)
        t, price = F.col("obs_at"), F.col("obs_price")
        aggs += [
            F.min(F.when(inside, F.struct(t.alias("at"), F.col("obs_id").alias("id"), price.alias("price")))).alias(f"__s{i}"),
            F.min(F.when(inside, F.struct(t.alias("at"), (-price).alias("p")))).alias(f"__h{i}"),
            F.min(F.when(inside, F.struct(t.alias("at"), price.alias("p")))).alias(f"__l{i}"),
            F.max(F.when(age < h.offset, price)).alias(f"__a{i}"),
            F.min(F.when(age < h.offset, price)).alias(f"__b{i}"),
        ]
    seen = pairs.groupBy(*SIGNAL_KEY).agg(*aggs)
    each = F.array(
        *[
            F.struct(
                F.lit(h.key).alias("horizon"), F.col(f"__s{i}").alias("selected"),
                F.greatest(F.col(f"__a{i}"), -F.col(f"__h{i}.p")).alias("path_high"),
                F.least(F.col(f"__b{i}"), F.col(f"__l{i}.p")).alias("path_low"),
            )
            for i, h in enumerate(horizons)
        ]
    )
    return seen.select(*SIGNAL_KEY, F.inline(each)).filter(F.col("selected").isNotNull())


def evaluate_outcomes(
    outcomes: DataFrame, observed: DataFrame, high_watermark: Column, observed_at: Column
) -> DataFrame:
    """MATURED with a selected price, INSUFFICIENT_DATA once the frontier passed the window, else PENDING."""
    joined = outcomes.join(observed, [*SIGNAL_KEY, "horizon"], "left")
    entry, chosen = F.col("entry_price_usd"), F.col("selected")
    matured = (F.col("status") == "PENDING") & chosen.isNotNull()
    status = (
        F.when(matured, "MATURED")
        .when((F.col("status") == "PENDING") & (observed_at > F.col("window_end_at")), "INSUFFICIENT_DATA")
        .otherwise(F.col("status"))
    )
    zero = F.lit(0.0)
    return (
        joined.withColumn("selected_snapshot_id", F.when(matured, chosen["id"]))
        .withColumn("selected_at", F.when(matured, chosen["at"]))
        .withColumn("selection_delay_seconds", F.when(matured, whole_seconds(chosen["at"], F.col("target_at"))))
        .withColumn("return_decimal", F.when(matured, chosen["price"] / entry - 1))
        .withColumn("mfe_decimal", F.when(matured, F.greatest(zero, F.col("path_high") / entry - 1)))
        .withColumn("mae_decimal", F.when(matured, F.least(zero, F.col("path_low") / entry - 1)))
        .withColumn("status", status)
        .withColumn(
            "evaluation_watermark", F.when(F.col("status").isin("MATURED", "INSUFFICIENT_DATA"), high_watermark)
        )
        .drop("selected", "path_high", "path_low")
    )


def project_to_watermark(outcomes: DataFrame, high_watermark: Column) -> DataFrame:
    """The study as of a watermark: later signals vanish, later evaluations become pending again."""
    late = F.coalesce(F.col("evaluation_watermark") > high_watermark, F.lit(False))
    out = outcomes.filter(F.col("signal_snapshot_id") <= high_watermark).withColumn("__late", late)
    for metric in ("return_decimal", "mfe_decimal", "mae_decimal"):
        out = out.withColumn(metric, F.when(~F.col("__late"), F.col(metric)))
    return out.withColumn("status", F.when(F.col("__late"), "PENDING").otherwise(F.col("status"))).drop("__late")


def score_versions(signals: DataFrame, high_watermark: Column) -> DataFrame:
    return signals.filter(F.col("signal_snapshot_id") <= high_watermark).select("score_version").distinct()


def _scoped(outcomes: DataFrame) -> DataFrame:
    evidence = F.upper(F.coalesce(F.col("evidence_confidence"), F.lit("")))
    return outcomes.select(
        F.col("signal_source").alias("signal_source_scope"),
        F.upper(F.coalesce(F.col("chain"), F.lit(""))).alias("chain_scope"),
        F.when(evidence.isin("HIGH", "GOOD"), "HIGH_GOOD").when(evidence.isin("MEDIUM", "LOW"), "MEDIUM_LOW")
        .otherwise("UNKNOWN").alias("evidence_scope"),
        "score_version", "threshold", "horizon", "entry_status", "status", "return_decimal", "mfe_decimal", "mae_decimal",
    )


def _all_scopes(fine: DataFrame) -> DataFrame:
    """Repeat pre-aggregated rows into their named and their ALL cells; unnamed cells are dropped."""
    out = fine
    for column in CELL_KEY[:3]:
        out = out.withColumn(column, F.explode(F.array(F.col(column), F.lit("ALL"))))
    return out.filter(
        F.col("signal_source_scope").isin(*SOURCE_SCOPES) & F.col("chain_scope").isin(*CHAIN_SCOPES)
    )


def threshold_statistics(
    outcomes: DataFrame, versions: DataFrame, thresholds: Sequence[int] = THRESHOLDS, horizons: Sequence[Horizon] = HORIZONS
) -> DataFrame:
    """Counts, coverages, positive rate and exact medians for every scope cell, empty cells included."""
    scoped = _scoped(outcomes)
    evaluable = F.col("entry_status") == "EVALUABLE"
    matured = evaluable & (F.col("status") == "MATURED")
    fine = scoped.groupBy(*CELL_KEY).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(evaluable).alias("evaluable"),
        F.count_if(evaluable & (F.col("status") == "PENDING")).alias("pending"),
        F.count_if(matured).alias("matured"),
        F.count_if(evaluable & (F.col("status") == "INSUFFICIENT_DATA")).alias("insufficient"),
        F.count_if(matured & (F.col("return_decimal") > 0)).alias("positive"),
    )
    measures = ("signals", "evaluable", "pending", "matured", "insufficient", "positive")
    cells = _all_scopes(fine).groupBy(*CELL_KEY).agg(*[F.sum(m).alias(m) for m in measures])

    metrics = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_decimal").alias("v")) for m in ("return", "mfe", "mae")]
    )
    values = (
        scoped.filter(matured).select(*CELL_KEY, F.inline(metrics)).groupBy(*CELL_KEY, "metric", "v")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    medians = grouped_median(
        values, [*CELL_KEY, "metric"], "v", "m", "w", _all_scopes, ["score_version", "threshold", "horizon", "metric"]
    )
    medians = medians.groupBy(*CELL_KEY).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("m"))).alias(f"median_{m}") for m in ("return", "mfe", "mae")]
    )
    grid = versions.select("score_version")
    for column, options in (
        ("signal_source_scope", SOURCE_SCOPES), ("chain_scope", CHAIN_SCOPES), ("evidence_scope", EVIDENCE_SCOPES),
        ("threshold", thresholds), ("horizon", [h.key for h in horizons]),
    ):
        grid = grid.withColumn(column, F.explode(F.array(*[F.lit(o) for o in options])))
    grid = grid.withColumn("threshold", F.col("threshold").cast("bigint"))
    full = grid.join(cells, list(CELL_KEY), "left").join(medians, list(CELL_KEY), "left")
    for m in measures:
        full = full.withColumn(m, F.coalesce(F.col(m), F.lit(0)).cast("bigint"))

    def share(n: Column, d: Column) -> Column:
        return F.when(d != 0, n / d)

    terminal = F.col("matured") + F.col("insufficient")
    return full.select(
        *CELL_KEY, "signals", "evaluable", (F.col("signals") - F.col("evaluable")).alias("not_evaluable"),
        share(F.col("evaluable"), F.col("signals")).alias("entry_price_coverage"),
        "pending", "matured", "insufficient",
        share(terminal, F.col("evaluable")).alias("maturity_coverage"),
        share(F.col("matured"), terminal).alias("result_coverage"),
        share(F.col("positive"), F.col("matured")).alias("positive_return_rate"),
        "median_return", "median_mfe", "median_mae",
        (F.col("matured") < MIN_SAMPLE).alias("insufficient_sample"),
    )


def report_order() -> list[Column]:
    """Order of a statistics report: backfill, live, all, then the remaining cell key."""
    source = F.when(F.col("signal_source_scope") == "BACKFILL", 1).when(F.col("signal_source_scope") == "LIVE", 2).otherwise(3)
    return [source, F.col("chain_scope"), F.col("evidence_scope"), F.col("score_version"), F.col("threshold"), F.col("horizon")]


def compare_versions(statistics: DataFrame, champion: str, versions: Sequence[str] | None = None) -> DataFrame:
    """Statistics of the wanted versions with each challenger's difference to the champion's cell."""
    key = [c for c in CELL_KEY if c != "score_version"]
    metrics = ("positive_return_rate", "median_return", "median_mfe", "median_mae")
    wanted = statistics if versions is None else statistics.filter(F.col("score_version").isin(*versions))
    base = wanted.filter(F.col("score_version") == champion).select(
        *key, *[F.col(m).alias(f"__c_{m}") for m in metrics]
    )
    joined = wanted.join(base, key, "left")
    rival = F.col("score_version") != champion
    return joined.select(
        *CELL_KEY, "signals", "matured", *metrics,
        *[F.when(rival, F.col(m) - F.col(f"__c_{m}")).alias(f"delta_{m}") for m in metrics],
        F.when(F.col("insufficient_sample"), "INSUFFICIENT").otherwise("OK").alias("sample"),
    )


def integrity_audit(outcomes: DataFrame, high_watermark: Column) -> DataFrame:
    """Violation counts of the study's rules; every count must be zero."""
    matured = F.col("status") == "MATURED"
    metrics = ("selected_snapshot_id", "selected_at", "return_decimal", "mfe_decimal", "mae_decimal")
    any_null, any_value = F.lit(False), F.lit(False)
    for m in metrics:
        any_null, any_value = any_null | F.col(m).isNull(), any_value | F.col(m).isNotNull()
    checks = {
        "selected_not_later": matured & (
            (F.col("selected_at") <= F.col("signal_at")) | (F.col("selected_snapshot_id") <= F.col("signal_snapshot_id"))
        ),
        "selected_outside_window": matured & (
            (F.col("selected_at") < F.col("target_at")) | (F.col("selected_at") > F.col("window_end_at"))
        ),
        "selected_above_watermark": matured & (F.col("selected_snapshot_id") > high_watermark),
        "matured_without_metrics": matured & any_null,
        "metrics_without_maturity": ~matured & any_value,
        "excursion_sign": matured & ((F.col("mfe_decimal") < 0) | (F.col("mae_decimal") > 0)),
        "entry_price_mismatch": (F.col("entry_status") == "EVALUABLE") != F.coalesce(F.col("entry_price_usd") > 0, F.lit(False)),
    }
    per_key = outcomes.groupBy(*SIGNAL_KEY, "horizon").agg(
        F.count(F.lit(1)).alias("__copies"), *[F.count_if(c).alias(n) for n, c in checks.items()]
    )
    return per_key.agg(
        F.coalesce(F.count_if(F.col("__copies") > 1), F.lit(0)).alias("duplicate_keys"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in checks],
    )


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.2f%%", value * 100))


def report_lines(statistics: DataFrame) -> DataFrame:
    """One text line per statistic."""
    line = F.concat_ws(
        " ",
        F.concat("chain_scope", F.lit("/"), "evidence_scope"),
        F.concat(F.lit("v="), "score_version"),
        F.concat(F.lit("score>="), F.col("threshold").cast("string")),
        F.concat(F.lit("horizon="), "horizon"),
        F.concat(F.lit("signals="), F.col("signals").cast("string")),
        F.concat(F.lit("evaluable="), F.col("evaluable").cast("string")),
        F.concat(F.lit("entry="), percent_text(F.col("entry_price_coverage"))),
        F.concat(F.lit("matured="), F.col("matured").cast("string")),
        F.concat(F.lit("result="), percent_text(F.col("result_coverage"))),
        F.concat(F.lit("win="), percent_text(F.col("positive_return_rate"))),
        F.concat(F.lit("median="), percent_text(F.col("median_return"))),
        F.concat(F.lit("mfe="), percent_text(F.col("median_mfe"))),
        F.concat(F.lit("mae="), percent_text(F.col("median_mae"))),
        F.concat(F.lit("sample_low="), F.col("insufficient_sample").cast("string")),
    )
    return statistics.select(F.col("signal_source_scope").alias("section"), line.alias("line"))
