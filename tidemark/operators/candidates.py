"""Discovery candidates: merging sources, market evidence, admission, filtering and preliminary scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import quality as q
from tidemark.functions.identity import canonical_address, token_id
from tidemark.functions.timecol import HOUR, MINUTE, SECOND, micros
from tidemark.operators.order_stats import top_n_per_group

# Sources, limits, ladders, field lists.
SOURCE_TRENDING, SOURCE_TOP_VOLUME = "GECKO_TRENDING", "GECKO_TOP_VOLUME"
SOURCE_BOOST, SOURCE_LOCAL = "DEX_BOOST_TOP", "LOCAL_UNIVERSE"
ADMISSION_PRIORITY = {"ANOMALY": 300, "TRENDING": 200, "HISTORICAL": 100}
CANDIDATE_MAX_AGE, EARLY_MAX_AGE = 6 * HOUR, 2 * HOUR
MIN_LIQUIDITY, PREFERRED_MAX_CAP = 2000.0, 500000.0
DEEP_THRESHOLD = 40.0
DEPRIORITY_PENALTY = 10.0
UNIVERSE_PER_CHAIN = 5000
MERGE_FIELDS = (
    "price_usd", "market_cap_usd", "fdv_usd", "liquidity_usd", "volume_m5_usd", "volume_h1_usd", "volume_h6_usd",
    "volume_24h_usd", "buys_m5", "sells_m5", "buys_h1", "sells_h1", "buys_h6", "sells_h6", "buys_h24", "sells_h24",
    "price_change_m5", "price_change_h1", "price_change_h6", "price_change_h24", "holders", "boosts_active",
)
PRESENCE_FIELDS = (
    "price_usd", "market_cap_usd", "fdv_usd", "liquidity_usd", "volume_m5_usd", "volume_h1_usd", "volume_h6_usd",
    "volume_24h_usd", "buys_m5", "sells_m5", "price_change_h1",
)
COUNT_FIELDS = (
    "price_usd", "market_cap_usd", "fdv_usd", "liquidity_usd", "volume_m5_usd", "volume_h1_usd", "volume_h6_usd",
    "volume_24h_usd", "price_change_m5", "price_change_h1", "price_change_h6", "price_change_h24",
)
QUALITY_FIELDS = (
    "price_usd", "market_cap_usd", "fdv_usd", "liquidity_usd", "volume_m5_usd", "volume_h1_usd", "volume_h6_usd",
    "volume_24h_usd", "buys_m5", "sells_m5", "buys_h1", "sells_h1", "buys_h6", "sells_h6", "buys_h24", "sells_h24",
    "aggregate_buyers_m5", "aggregate_sellers_m5", "aggregate_buyers_h1", "aggregate_sellers_h1", "aggregate_buyers_h6",
    "aggregate_sellers_h6", "aggregate_buyers_h24", "aggregate_sellers_h24", "buyers_m5", "sellers_m5",
    "price_change_h1", "price_change_h6", "price_change_h24",
)
AGE_FIELDS = (
    "discovery_pool_created_at", "market_discovery_pool_created_at", "chain_created_at", "trigger_pool_created_at",
    "market_trigger_pool_created_at", "selected_pair_created_at", "pair_created_at",
)


def _has(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def distinct_sorted(sources: Column) -> Column:
    """Distinct non-empty sources in order."""
    return F.array_sort(F.array_distinct(F.filter(sources, lambda s: _has(s))))


def normalize(candidates: DataFrame) -> DataFrame:
    """Canonical addresses and ids, default origin; rows without an address are dropped."""
    out = candidates.filter(_has(F.col("address")))
    for name in ("address", "pair_address", "discovery_pool_address", "trigger_pool_address"):
        if name in out.columns:
            out = out.withColumn(name, canonical_address(F.col("chain"), F.col(name)))
    return out.withColumn("token_id", token_id(F.col("chain"), F.col("address"))).withColumn(
        "origin", F.when(_has(F.col("origin")), F.col("origin")).otherwise("LAUNCH")
    )


def first_per_token(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep the first row per canonical id in source order, reduced map-side."""
    row = F.struct(*candidates.columns)
    return candidates.groupBy("token_id").agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def any_evidence(qualities: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in qualities:
        out = out | q.usable(c)
    return out


def evidence_count(qualities: Sequence[Column]) -> Column:
    out = F.lit(0)
    for c in qualities:
        out = out + q.usable(c).cast("int")
    return out


def merge_candidates(candidates: DataFrame, seq: str) -> DataFrame:
    """One row per token from every source that saw it.

    ``seq`` is the arrival order. Text fields keep their first non-empty value, the pair prefers
    the latest non-launch source, the market the best (quality, evidence, time, pair). All
    parts are mergeable aggregates, so a token named by every source stays cheap.
    """
    df = normalize(candidates)
    c = F.col
    at = c(seq)

    def first_text(name: str) -> Column:
        return F.min_by(c(name), F.when(_has(c(name)), at))

    quality_rank = F.when(c("market.market_data_quality") == "full", 2).when(
        c("market.market_data_quality") == "partial", 1
    ).otherwise(0)
    rank = F.struct(quality_rank, c("market.evidence_count"), c("market.collected_at"), c("market.pair_address"), -at)
    pair, momentum = c("pair_address"), c("origin") != "LAUNCH"
    has_discovery, has_trigger = _has(c("discovery_pool_address")), _has(c("trigger_pool_address"))
    return df.groupBy("token_id", "chain").agg(
        F.min_by("address", at).alias("address"), first_text("name").alias("name"), first_text("symbol").alias("symbol"),
        F.when(F.min("origin") == F.max("origin"), F.min("origin")).otherwise("BOTH").alias("origin"),
        distinct_sorted(F.flatten(F.collect_set("momentum_sources"))).alias("momentum_sources"),
        first_text("discovery_pool_address").alias("discovery_pool_address"),
        F.min_by("discovery_pool_created_at", F.when(has_discovery, at)).alias("discovery_pool_created_at"),
        first_text("trigger_pool_address").alias("trigger_pool_address"),
        F.min_by("trigger_pool_created_at", F.when(has_trigger, at)).alias("trigger_pool_created_at"),
        F.coalesce(F.max_by(pair, F.when(_has(pair) & momentum, at)), first_text("pair_address")).alias("pair_address"),
        F.min_by("chain_created_at", F.when(c("chain_created_at").isNotNull(), at)).alias("chain_created_at"),
        F.min("detected_at").alias("detected_at"),
        F.max_by("market", rank).alias("market"),
        F.count(F.lit(1)).alias("observations"),
    )


def merge_market(base: DataFrame, pair: DataFrame, fields: Sequence[str] = MERGE_FIELDS) -> DataFrame:
    """Overlay pair evidence on pool evidence field by field, quality included.

    ``base`` and ``pair`` hold tagged fields under the same names, keyed by token_id.
    """
    right = pair.select("token_id", F.lit(True).alias("__found"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = base.join(right, "token_id", "left")
    present = [f for f in PRESENCE_FIELDS if f in fields]
    had = any_evidence([F.col(f)["quality"] for f in present])
    found = F.coalesce(F.col("__found"), F.lit(False))
    merged = {f: F.when(found, q.prefer(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}
    out = joined.withColumn("market_data_source", F.when(~found, "gecko").when(had, "merged").otherwise("dex")).withColumn(
        "market_data_quality", F.when(found, "full").otherwise("partial")
    )
    return out.withColumns(merged).drop("__found", *[f"__{f}" for f in fields])


def quality_map(df: DataFrame, fields: Sequence[str] = QUALITY_FIELDS) -> Column:
    """Canonical quality per market field; fields a source does not carry are missing."""
    parts: list[Column] = []
    for f in fields:
        level = q.canonical_quality(F.col(f)["quality"]) if f in df.columns else F.lit(q.MISSING)
        parts += [F.lit(f), level]
    return F.create_map(*parts)


def token_age(now: Column, *created: Column) -> Column:
    """Microseconds since the first known creation time, never negative; NULL when none is known."""
    start = F.coalesce(*created)
    return F.when(start.isNotNull(), F.greatest(F.lit(0), micros(now) - micros(start)))


def age_provenance(existing: Column, chain_created: Column, pair_times: Sequence[Column]) -> Column:
    """Where an age came from; an existing provenance is kept."""
    return (
        F.when(_has(existing), existing).when(chain_created.isNotNull(), "ON_CHAIN_CREATION")
        .when(F.coalesce(*pair_times).isNotNull(), "EARLIEST_PAIR").otherwise("LOCAL_FIRST_SEEN_LOWER_BOUND")
    )


def admission_source(sources: Column, origin: Column) -> Column:
    anomaly = F.arrays_overlap(sources, F.array(F.lit(SOURCE_TOP_VOLUME), F.lit(SOURCE_LOCAL)))
    return F.when(F.coalesce(anomaly, F.lit(False)), "ANOMALY").when(origin.isin("MOMENTUM", "BOTH"), "TRENDING").otherwise("HISTORICAL")


def admission_priority(source: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ADMISSION_PRIORITY.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def fast_filter(origin: Column, age: Column, liquidity: Column, market_cap: Column) -> Column:
    """Decision struct: accepted, reject_reason, age_band, deprioritized. ``age`` in microseconds."""
    momentum = origin.isin("MOMENTUM", "BOTH")
    reason = F.when(~momentum & (age > CANDIDATE_MAX_AGE), "too_old").when(
        q.value_if_available(liquidity) < MIN_LIQUIDITY, "low_liquidity"
    )
    band = (
        F.when(age.isNull() | (~momentum & (age > CANDIDATE_MAX_AGE)), "UNKNOWN")
        .when(age <= EARLY_MAX_AGE, "EARLY_POOL").otherwise("EARLY_LATE")
    )
    costly = F.coalesce(q.value_if_available(market_cap) > PREFERRED_MAX_CAP, F.lit(False))
    return F.struct(
        reason.isNull().alias("accepted"), reason.alias("reject_reason"), band.alias("age_band"),
        (reason.isNull() & ~momentum & costly).alias("deprioritized"),
    )


def launch_type(now: Column, selected_created: Column, pair_created: Column, first_seen: Column) -> Column:
    created = F.coalesce(selected_created, pair_created)
    old = lambda t: F.coalesce(micros(now) - micros(t) > EARLY_MAX_AGE, F.lit(False))
    return F.struct(
        F.when(old(created) | old(first_seen), "REACTIVATION").otherwise("NEW_LAUNCH").alias("launch_type"),
        F.when(old(created), "older_selected_pair").when(old(first_seen), "previously_observed_token")
        .otherwise("no_older_evidence").alias("reason"),
    )


def preliminary_score(
    volume_m5: Column, volume_h1: Column, buys: Column, sells: Column, liquidity: Column, cap: Column, age: Column,
    deprioritized: Column,
) -> Column:
    """Components and capped total of the score that orders candidates before full scoring."""
    val = q.value_if_available
    zero = F.lit(0.0)
    pace = q.open_ratio(val(volume_m5), val(volume_h1) / 12.0)
    acceleration = F.coalesce(F.when(pace.isNotNull(), q.ladder(pace, q.VELOCITY_LADDER, 25.0)), zero)
    press = q.open_ratio(val(buys), val(sells))
    pressure = F.coalesce(F.when(press.isNotNull(), q.ladder(press, q.VELOCITY_LADDER, 20.0)), zero)
    total = val(buys) + val(sells)
    breadth = F.when(total >= 20, 20.0).when(total >= 10, 15.0).when(total >= 5, 10.0).when(total > 0, 5.0).otherwise(zero)
    depth = q.open_ratio(val(liquidity), val(cap))
    quality_points = (
        F.when(depth >= 0.20, 15.0).when(depth >= 0.10, 12.0).when(depth >= 0.05, 9.0).when(depth >= 0.02, 6.0)
        .when(depth >= 0.01, 3.0).otherwise(zero)
    )
    youth = (
        F.when(age <= 30 * MINUTE, 20.0).when(age <= HOUR, 15.0).when(age <= 2 * HOUR, 10.0).when(age <= 6 * HOUR, 5.0)
        .otherwise(zero)
    )
    capped = F.least(acceleration + pressure + breadth + quality_points + youth, F.lit(100.0))
    final = F.when(deprioritized, F.greatest(zero, capped - DEPRIORITY_PENALTY)).otherwise(capped)
    return F.struct(
        acceleration.alias("volume_acceleration"), pressure.alias("buy_pressure"), quality_points.alias("liquidity_quality"),
        youth.alias("age_bonus"), breadth.alias("activity_breadth"), final.alias("total"),
        (final >= DEEP_THRESHOLD).alias("deep_eligible"),
    )


def candidate_order() -> list[Column]:
    """Best score first, deprioritized rows after equal scores, then id."""
    return [F.col("score").desc_nulls_last(), F.col("deprioritized").asc(), F.col("token_id").asc()]


def latest_evidence_time(fallback: Column, *tagged_values: Column) -> Column:
    """Newest collection time among usable values and the fallback."""
    return F.greatest(fallback, *[F.when(q.available(v), v["collected_at"]) for v in tagged_values])


def momentum_evidence(df: DataFrame) -> Column:
    """Raw factor envelope with window fallbacks; a ratio is left out when nothing was sold."""

    def factor(options: Sequence[tuple[str, str]], unit: str) -> Column:
        first_window = options[0][1]
        out = F.struct(
            F.lit(False).alias("available"), F.lit(None).cast("double").alias("value"), F.lit(unit).alias("unit"),
            F.lit(options[-1][1] if len(options) > 1 else first_window).alias("window"),
        )
        for column, window in reversed(options):
            tagged = F.col(column)
            hit = F.struct(
                F.lit(True).alias("available"), tagged["value"].cast("double").alias("value"), F.lit(unit).alias("unit"),
                F.lit(window).alias("window"),
            )
            out = F.when(q.available(tagged), hit).otherwise(out)
        return out

    h1 = q.available(F.col("buys_h1")) & q.available(F.col("sells_h1"))
    buys = F.when(h1, q.value_if_available(F.col("buys_h1"))).otherwise(q.value_if_available(F.col("buys_m5")))
    sells = F.when(h1, q.value_if_available(F.col("sells_h1"))).otherwise(q.value_if_available(F.col("sells_m5")))
    known = F.coalesce(buys.isNotNull() & (sells > 0), F.lit(False))
    ratio = F.struct(
        known.alias("available"), F.when(known, q.divide(buys, sells)).alias("value"), F.lit("ratio").alias("unit"),
        F.when(known & ~h1, "m5").otherwise("h1").alias("window"),
    )
    absent = F.struct(
        F.lit(False).alias("available"), F.lit(None).cast("double").alias("value"), F.lit("count").alias("unit"),
        F.lit("current").alias("window"),
    )
    return F.create_map(
        F.lit("price_momentum"), factor([("price_change_h1", "h1"), ("price_change_m5", "m5")], "percent"),
        F.lit("volume_activity"), factor([("volume_h1_usd", "h1"), ("volume_24h_usd", "h24")], "usd"),
        F.lit("buy_pressure"), ratio,
        F.lit("aggregate_buyer_activity"),
        factor([("aggregate_buyers_h1", "h1"), ("aggregate_buyers_m5", "m5")], "addresses_aggregate"),
        F.lit("liquidity"), factor([("liquidity_usd", "current")], "usd"),
        F.lit("social"), absent,
    )


# ---- pairs, coverage and reports ----------------------------------------------------------------


def wanted_pairs(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs of the requested tokens only."""
    return pairs.join(seeds.select("chain", "token_id").distinct(), ["chain", "token_id"], "left_semi")


def best_pairs(pairs: DataFrame, position: str) -> DataFrame:
    """Most liquid pair per token, first on ties, with the earliest creation among all its pairs."""
    cols = F.struct(*[c for c in pairs.columns if c != "token_id"])
    rank = F.when(F.col("liquidity_usd").isNotNull(), F.struct(F.col("liquidity_usd"), -F.col(position)))
    return (
        pairs.groupBy("token_id").agg(F.max_by(cols, rank).alias("b"), F.min("pair_created_at").alias("earliest_pair_at"))
        .filter(F.col("b").isNotNull()).select("token_id", "b.*", "earliest_pair_at")
    )


def discovery_coverage(pools: DataFrame) -> DataFrame:
    """Newest and oldest of all pools and pages, and distinct tokens of the ``kept`` ones, per run and chain."""
    return pools.groupBy("run_id", "chain").agg(
        F.max("pool_created_at").alias("newest_pool_at"), F.min("pool_created_at").alias("oldest_pool_at"),
        F.countDistinct("page").alias("pages_fetched"), F.countDistinct(F.when(F.col("kept"), F.col("token_id"))).alias("unique_candidates"),
    )


def source_report(items: DataFrame) -> DataFrame:
    """Returned against distinct items per run, chain and source, with the first error."""
    return items.groupBy("run_id", "chain", "source").agg(
        F.count(F.lit(1)).alias("returned_items"),
        F.countDistinct(F.when(F.col("error").isNull(), F.col("token_id"))).alias("unique_candidates"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("first_error"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("candidates"))


# ---- bounded active universe --------------------------------------------------------------------


def universe_strength() -> list[Column]:
    """Strongest member first; an absent measure is the weakest."""
    return [
        F.col("last_momentum_at").desc_nulls_last(), F.col("last_trade_at").desc_nulls_last(),
        F.col("liquidity_usd").desc_nulls_last(), F.col("volume_h24_usd").desc_nulls_last(),
        F.col("last_seen_at").desc_nulls_last(), F.col("token_id").desc(),
    ]


def merge_universe_evidence(observations: DataFrame) -> DataFrame:
    """Membership evidence per token: newest times, newest known measures, highest admission."""
    at = F.col("observed_at")
    priority = admission_priority(F.col("admission_source"))

    def newest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.struct(at, F.col("seq"))))

    return observations.groupBy("chain", "token_id").agg(
        F.max_by("admission_source", F.struct(priority, -F.col("seq"))).alias("admission_source"),
        F.max(priority).alias("admission_priority"), F.min(at).alias("first_added_at"), F.max(at).alias("last_seen_at"),
        F.max(F.when(F.col("admission_source") != "HISTORICAL", at)).alias("last_momentum_at"),
        F.max("last_trade_at").alias("last_trade_at"), newest("liquidity_usd").alias("liquidity_usd"),
        newest("volume_h24_usd").alias("volume_h24_usd"),
    )


def bounded_universe(evidence: DataFrame, size: int = UNIVERSE_PER_CHAIN) -> DataFrame:
    """The ``size`` strongest members per chain, cut in two rounds so a hot chain stays parallel."""
    return top_n_per_group(evidence, ["chain"], universe_strength(), size, size, F.col("token_id"))


def seed_from_history(tokens: DataFrame, members: DataFrame, size: int = UNIVERSE_PER_CHAIN) -> DataFrame:
    """Fill each chain's free places with the strongest known tokens that are not members yet."""
    counts = members.groupBy("chain").agg(F.count(F.lit(1)).alias("__have"))
    fresh = tokens.join(members.select("token_id"), "token_id", "left_anti").join(counts, "chain", "left")
    fresh = fresh.withColumn("__free", F.greatest(F.lit(0), F.lit(size) - F.coalesce(F.col("__have"), F.lit(0))))
    order = [
        F.col("origin").isin("MOMENTUM", "BOTH").desc(), F.col("collected_at").desc_nulls_last(),
        F.col("liquidity_usd").desc_nulls_last(), F.col("volume_h24_usd").desc_nulls_last(),
        F.coalesce(F.col("collected_at"), F.col("first_seen_at")).desc(), F.col("token_id").desc(),
    ]
    return top_n_per_group(fresh, ["chain"], order, F.col("__free"), size, F.col("token_id")).drop("__have", "__free")


def latest_state(observations: DataFrame) -> DataFrame:
    """Newest observation per token; an older or equally old one never replaces it."""
    cols = F.struct(*[c for c in observations.columns if c != "token_id"])
    return observations.groupBy("token_id").agg(
        F.max_by(cols, F.struct("observed_at", -F.col("seq"))).alias("s")
    ).select("token_id", "s.*")
