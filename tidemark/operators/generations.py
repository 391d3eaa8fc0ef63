"""Snapshot generations and the views read from them: current tokens, radar, archive, timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import quality as q
from tidemark.functions.identity import canonical_address
from tidemark.functions.timecol import HOUR, MINUTE, SECOND, micros, plus, whole_seconds
from tidemark.operators.joins import interval_join
from tidemark.session import staged

# Generation states, limits and display ranks.
OPEN_STATES = ("pending", "queued", "deferred")
RADAR_LIMIT, ARCHIVE_LIMIT, TIMELINE_LIMIT = 30, 500, 100
HISTORY_LIMIT = 12
FALLING_FAST = -20.0
TIER_ORDER = ("BREAKOUT", "FAST_RISING", "WATCH")
CONFIDENCE_ORDER = ("HIGH", "GOOD", "MEDIUM", "LOW")


def latest_fast(snapshots: DataFrame) -> DataFrame:
    """Highest FAST snapshot id per token."""
    return snapshots.filter(F.col("stage") == "FAST").groupBy("token_id").agg(F.max("id").alias("latest_fast_id"))


def current_generation(snapshots: DataFrame) -> DataFrame:
    """Per token the newest DEEP row of its latest FAST row, else that FAST row itself.

    One partially aggregated pass: each generation keeps one row, then each token keeps one.
    """
    row = F.struct(*snapshots.columns)
    generation = F.when(F.col("stage") == "FAST", F.col("id")).otherwise(F.col("base_fast_snapshot_id"))
    rank = F.struct((F.col("stage") == "DEEP").alias("deep"), F.col("id").alias("id"))
    per = (
        snapshots.withColumn("__g", generation).filter(F.col("__g").isNotNull()).groupBy("token_id", "__g")
        .agg(F.max_by(row, rank).alias("row"), F.max(F.col("stage") == "FAST").alias("has_fast"))
        .filter("has_fast")
    )
    return per.groupBy("token_id").agg(F.max_by("row", "__g").alias("row")).select("row.*")


def mark_stale(snapshots: DataFrame) -> DataFrame:
    """Open FAST rows older than the token's latest FAST row become stale."""
    joined = snapshots.join(latest_fast(snapshots), "token_id", "left")
    old = (F.col("stage") == "FAST") & (F.col("id") < F.col("latest_fast_id")) & F.col("deep_status").isin(*OPEN_STATES)
    return joined.withColumn("deep_status", F.when(old, "stale").otherwise(F.col("deep_status"))).drop("latest_fast_id")


def accept_deep(deep: DataFrame, current_base: str) -> DataFrame:
    """DEEP rows whose base is the token's current FAST row on arrival; one per base, the first wins."""
    fitting = deep.filter(F.col("base_fast_snapshot_id") == F.col(current_base))
    row = F.struct(*deep.columns)
    return (
        fitting.groupBy("token_id", "base_fast_snapshot_id").agg(F.min_by(row, "id").alias("row")).select("row.*")
    )


def pending_deep(snapshots: DataFrame) -> DataFrame:
    """Latest FAST rows whose deep work is still open."""
    fast = snapshots.filter(F.col("stage") == "FAST")
    newest = fast.groupBy("token_id").agg(F.max_by(F.struct(*snapshots.columns), "id").alias("row")).select("row.*")
    return newest.filter(F.col("deep_status").isin(*OPEN_STATES))


def generation_status(snapshots: DataFrame) -> DataFrame:
    """Queued, completed and failed counts over the latest FAST rows."""
    fast = snapshots.filter(F.col("stage") == "FAST")
    newest = fast.groupBy("token_id").agg(F.max_by("deep_status", "id").alias("deep_status"))
    state = F.col("deep_status")
    return newest.agg(
        F.count_if(state.isin(*OPEN_STATES)).alias("deep_queued"), F.count_if(state == "completed").alias("deep_completed"),
        F.count_if(state == "failed").alias("deep_failed"),
    )


def participants(unique_buyers: Column, unique_sellers: Column, all_buyers: Column, all_sellers: Column) -> Column:
    """Address-level counts when either side has them, else the provider's aggregates."""
    unique = unique_buyers.isNotNull() | unique_sellers.isNotNull()
    rough = all_buyers.isNotNull() | all_sellers.isNotNull()
    return F.struct(
        F.when(unique, unique_buyers).when(rough, all_buyers).alias("buyers"),
        F.when(unique, unique_sellers).when(rough, all_sellers).alias("sellers"),
        F.when(unique, "address_deduplicated").when(rough, "provider_aggregate").otherwise("unavailable").alias("evidence"),
    )


def age_or_null(collected_at: Column, *created: Column) -> Column:
    """Whole seconds since the first known creation time; NULL when it lies in the future."""
    start = F.coalesce(*created) if len(created) > 1 else created[0]
    return F.when(start <= collected_at, whole_seconds(collected_at, start))


PREVIOUS_FIELDS = (
    "raw_score", "volume_m5_usd", "buyers_m5", "sellers_m5", "aggregate_buyers_m5", "aggregate_sellers_m5", "collected_at",
)


def token_views(current: DataFrame, snapshots: DataFrame, lookback: int = 5 * MINUTE, bucket: int = HOUR) -> DataFrame:
    """Current rows with the earliest snapshot of the look-back before them and derived changes.

    Only the current row of each token looks back, through a bucketed range join. Those rows feed
    both sides of the join and are staged once.
    """
    current = staged(current, "current-rows")
    names = [F.col(f).alias(f"p_{f}") for f in PREVIOUS_FIELDS if f != "collected_at"]
    before = snapshots.select("token_id", F.col("id").alias("p_id"), F.col("collected_at").alias("p_collected_at"), *names)
    spans = current.select(
        "token_id", F.timestamp_micros(micros("collected_at") - lookback).alias("__from"),
        F.timestamp_micros(micros("collected_at") - 1).alias("__to"),
    )
    pairs = interval_join(spans, before, ["token_id"], "__from", "__to", "p_collected_at", bucket=bucket)
    row = F.struct("p_id", *[f"p_{f}" for f in PREVIOUS_FIELDS])
    earliest = pairs.groupBy("token_id").agg(F.min_by(row, F.struct("p_collected_at", "p_id")).alias("p"))
    out = current.join(earliest, "token_id", "left")
    c = F.col
    now = participants(c("buyers_m5"), c("sellers_m5"), c("aggregate_buyers_m5"), c("aggregate_sellers_m5"))
    then = participants(c("p.p_buyers_m5"), c("p.p_sellers_m5"), c("p.p_aggregate_buyers_m5"), c("p.p_aggregate_sellers_m5"))
    out = out.withColumn("momentum", now).withColumn("previous_buyers_m5", F.when(c("p").isNotNull(), then["buyers"]))
    previous_volume = c("p.p_volume_m5_usd")
    return (
        out.withColumn("score_delta", c("raw_score") - c("p.p_raw_score"))
        .withColumn(
            "volume_change_percent",
            F.when(previous_volume > 0, (c("volume_m5_usd") - previous_volume) / previous_volume * 100),
        )
        .withColumn("buy_sell_ratio", F.when(c("momentum.sellers") > 0, c("momentum.buyers") / c("momentum.sellers")))
        .withColumn("pool_age_seconds", age_or_null(c("collected_at"), c("discovery_pool_created_at")))
        .withColumn("previous_snapshot_id", c("p.p_id"))
        .drop("p")
    )


def _rank_of(column: str, order: Sequence[str]) -> Column:
    out = F.lit(len(order) + 1)
    for i, name in reversed(list(enumerate(order, 1))):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def radar_order() -> list[Column]:
    """Tier, known change, change, score, confidence, pool creation, time, id."""
    return [
        _rank_of("effective_tier", TIER_ORDER), F.col("score_delta").isNull(), F.col("score_delta").desc_nulls_last(),
        F.col("raw_score").desc_nulls_last(), _rank_of("evidence_confidence", CONFIDENCE_ORDER),
        F.col("discovery_pool_created_at").desc_nulls_last(), F.col("collected_at").desc(), F.col("id").desc(),
    ]


def radar_gate() -> Column:
    strong = F.col("effective_tier").isin("BREAKOUT", "FAST_RISING")
    watched = (F.col("effective_tier") == "WATCH") & F.col("evidence_confidence").isin("HIGH", "GOOD")
    return strong | watched


def radar(views: DataFrame, limit: int = RADAR_LIMIT) -> DataFrame:
    return views.filter(radar_gate()).orderBy(*radar_order()).limit(limit)


def archive(
    views: DataFrame, text: str = "", chain: str = "", effective_tier: str = "", launch_type: str = "",
    evidence_confidence: str = "", data_quality: str = "", limit: int = ARCHIVE_LIMIT,
) -> DataFrame:
    """Current tokens filtered by text and exact attributes, in radar order."""
    rows = views
    if text.strip():
        needle = F.lit(text.strip().lower())
        hit = F.lit(False)
        for name in ("name", "symbol", "address"):
            hit = hit | F.contains(F.lower(F.col(name)), needle)
        rows = rows.filter(hit)
    for column, value in (
        ("chain", chain.lower()), ("effective_tier", effective_tier.upper()), ("launch_type", launch_type.upper()),
        ("evidence_confidence", evidence_confidence.upper()), ("market_data_quality", data_quality.lower()),
    ):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(*radar_order()).limit(limit)


def by_address(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolve requested (address, optional chain) pairs; several hits mark the request ambiguous."""
    left = wanted.withColumnRenamed("chain", "__chain").withColumnRenamed("address", "__address")
    folded = F.lower(F.col("__address"))
    keys = F.array(
        F.struct(F.lit("bsc").alias("chain"), folded.alias("__key")),
        F.struct(F.lit("solana").alias("chain"), F.col("__address").alias("__key")),
    )
    asked = left.select("*", F.inline(keys)).filter(F.col("__chain").isNull() | (F.col("__chain") == F.col("chain")))
    have = tokens.withColumn("__key", canonical_address(F.col("chain"), F.col("address")))
    hits = asked.join(have, ["chain", "__key"]).groupBy("__address").agg(
        F.count(F.lit(1)).alias("hits"), F.min("token_id").alias("token_id")
    )
    state = F.when(F.col("hits") == 1, "found").when(F.col("hits") > 1, "ambiguous").otherwise("not_found")
    return left.select("__address").distinct().join(hits, "__address", "left").select(
        F.col("__address").alias("address"), state.alias("state"), F.when(F.col("hits") == 1, F.col("token_id")).alias("token_id")
    )


def newest_per_token(snapshots: DataFrame, n: int, cutoffs: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` snapshots per token, or strictly before the token's cutoff.

    The rank limit is applied to each input partition before the shuffle, so a hot token sends
    only ``n`` rows per task.
    """
    rows = snapshots
    if cutoffs is not None:
        rows = rows.join(cutoffs, "token_id").filter(F.col("collected_at") < F.col("cutoff"))
    order = Window.partitionBy("token_id").orderBy(F.col("collected_at").desc(), F.col("id").desc())
    return rows.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def score_change(snapshots: DataFrame, limit: int = TIMELINE_LIMIT) -> DataFrame:
    """Change between the first and last scored points of each token's newest timeline."""
    points = newest_per_token(snapshots, limit).filter(F.col("raw_score").isNotNull())
    at = F.struct("collected_at", "id")
    ends = points.groupBy("token_id").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("raw_score", at).alias("__a"), F.max_by("raw_score", at).alias("__b"),
        F.min("collected_at").alias("__ta"), F.max("collected_at").alias("__tb"),
    )
    two = F.col("points") >= 2
    return ends.select(
        "token_id", "points", F.when(two, F.col("__b") - F.col("__a")).alias("score_change"),
        F.when(two, whole_seconds(F.col("__tb"), F.col("__ta"))).alias("score_change_seconds"),
        F.coalesce(two & (F.col("__b") - F.col("__a") <= FALLING_FAST), F.lit(False)).alias("falling_fast"),
    )


def provider_status(run_status: Column, error_text: Column, provider: str) -> Column:
    hit = F.contains(F.lower(F.coalesce(error_text, F.lit(""))), F.lit(provider.lower()))
    return F.when(hit, "degraded").when(run_status.isin("completed", "degraded"), "healthy").otherwise("unknown")


def latest_coverage(coverages: DataFrame) -> DataFrame:
    """Newest coverage per chain with the span it saw; NULL when the span is inverted."""
    cols = [c for c in coverages.columns if c != "chain"]
    newest = coverages.groupBy("chain").agg(
        F.max_by(F.struct(*cols), F.struct("scan_started_at", "id")).alias("r")
    ).select("chain", "r.*")
    span = F.when(
        F.col("newest_pool_at") >= F.col("oldest_pool_at"), whole_seconds(F.col("newest_pool_at"), F.col("oldest_pool_at"))
    )
    return newest.withColumn("duration_seconds", span)


def study_source(snapshots: DataFrame, scores: DataFrame, versions: DataFrame, after_id: Column, through_id: Column) -> DataFrame:
    """Snapshots of an id range with their version scores and configs, champion first.

    The id bounds reach the scan; versions are a control table of a few rows.
    """
    page = snapshots.filter((F.col("id") > after_id) & (F.col("id") <= through_id))
    return (
        page.join(scores.withColumnRenamed("snapshot_id", "id"), "id", "left").join(versions, "score_version", "left")
    )


def role_rank(role: Column) -> Column:
    return F.when(role == "CHAMPION", 0).when(role == "CHALLENGER", 1).otherwise(2)
