"""Domain frames derived from the generic star-schema and event tables.

Synthetic attributes (chain, quality, evidence level) are plain functions of table columns, so each
frame covers its whole source table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import quality as q
from tidemark.functions.timecol import DAY, HOUR, MINUTE, micros
from tidemark.session import use_utc

# Bar lengths standing in for the quarter-hour, hour, four-hour and day frames: the ship dates
# of the line items are whole days, so the finest bar is a day.
TEST_FRAMES = {"15m": DAY, "1H": 2 * DAY, "4H": 7 * DAY, "1Dutc": 28 * DAY}
RUN_WIDTH = 20 * MINUTE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_events(table(spark, sf_dir, "events"))


def adapt_events(events: DataFrame) -> DataFrame:
    """Events with a TIMESTAMP time and the integer inside ``props`` as ``k``."""
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.from_json("props", "k INT")["k"].alias("k"), *_file(events),
    )


def _file(df: DataFrame) -> list[str]:
    """The file of a row, where a stream tells it."""
    return [c for c in df.columns if c == "file"]


def chain_of(key: Column) -> Column:
    return F.when(key % 3 == 0, "bsc").when(key % 3 == 1, "solana").otherwise("base")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from(_events(spark, sf_dir))


def trades_from(events: DataFrame) -> DataFrame:
    side = F.when(F.col("event_type").isin("purchase", "signup"), "buy").when(
        F.col("event_type").isin("click", "error"), "sell"
    )
    return events.select(
        (F.col("user_id") % 10).alias("pool"),
        F.col("user_id").cast("string").alias("address"),
        side.alias("side"),
        F.col("value").alias("volume_usd"),
        F.col("ts").alias("traded_at"),
        *_file(events),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_from(_events(spark, sf_dir))


def snapshots_from(events: DataFrame) -> DataFrame:
    """Token snapshots with one raw score; a missing price is NULL."""
    chain = chain_of(F.col("user_id"))
    confidence = (
        F.when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "signup", "GOOD")
        .when(F.col("event_type") == "click", "MEDIUM").when(F.col("event_type") == "view", "LOW").otherwise("")
    )
    tier = (
        F.when(F.col("k") >= 85, "BREAKOUT").when(F.col("k") >= 70, "FAST_RISING")
        .when(F.col("k") >= 55, "WATCH").otherwise("HIDDEN")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(chain, F.lit(":"), F.col("user_id")).alias("token_id"),
        chain.alias("chain"),
        F.col("ts").alias("collected_at"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("price_usd"),
        F.col("k").cast("double").alias("raw_score"),
        tier.alias("effective_tier"),
        confidence.alias("evidence_confidence"),
        F.when(F.col("k") % 4 != 0, F.col("value") * 100.0).alias("liquidity_usd"),
        F.when(F.col("k") % 5 != 0, F.col("value") * F.col("k")).alias("volume_m5_usd"),
        F.when(F.col("k") % 3 != 0, F.col("k") % 17).alias("buyers_m5"),
        F.when(F.col("k") % 3 == 1, F.col("k") % 7).alias("sellers_m5"),
        (F.col("k") % 13).alias("aggregate_buyers_m5"),
        F.when(F.col("k") % 2 == 0, F.col("k") % 11).alias("aggregate_sellers_m5"),
        F.when(F.col("event_type").isin("purchase", "signup"), "DEEP").otherwise("FAST").alias("stage"),
        F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "queued")
        .when(F.col("event_type") == "error", "failed").otherwise("completed").alias("deep_status"),
        F.timestamp_micros(micros("ts") - F.col("k").cast("bigint") * 7 * MINUTE).alias("discovery_pool_created_at"),
    )


def snapshot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score versions per snapshot: the stored score as champion and a second as challenger."""
    return scores_from(snapshots(spark, sf_dir))


def scores_from(snaps: DataFrame) -> DataFrame:
    versions = F.array(
        F.struct(F.lit("V1").alias("score_version"), F.lit("CHAMPION").alias("role"), F.col("raw_score").alias("s")),
        F.struct(
            F.lit("V2").alias("score_version"), F.lit("CHALLENGER").alias("role"),
            ((F.col("raw_score") * 7 + 13) % 100).alias("s"),
        ),
    )
    return (
        snaps.withColumn("v", F.explode(versions))
        .withColumn("raw_score", F.col("v.s"))
        .withColumn("score_version", F.col("v.score_version"))
        .withColumn("role", F.col("v.role"))
        .drop("v")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced trades of an instrument: line items with price = extended price / quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("I"), F.col("l_suppkey") % 20, F.lit("-USDT-SWAP")).alias("instrument_id"),
        F.col("l_shipdate").cast("timestamp").alias("traded_at"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").alias("seq2"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("base_volume"),
        F.col("l_extendedprice").alias("quote_volume"),
    )


def as_of(priced: DataFrame) -> DataFrame:
    """One row: half a day after the last tick, so the newest daily bar is still open."""
    return priced.agg(F.timestamp_micros(F.max(micros("traded_at")) + 12 * HOUR).alias("as_of"))


def derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives_from(_events(spark, sf_dir))


def derivatives_from(events: DataFrame) -> DataFrame:
    n = F.col("user_id") % 20
    return events.select(
        F.col("event_id").alias("id"),
        F.when(n < 14, "crypto").otherwise("stock").alias("asset_class"),
        F.concat(F.lit("I"), n, F.lit("-USDT-SWAP")).alias("instrument_id"),
        F.concat(F.lit("I"), n).alias("symbol"),
        F.col("ts").alias("collected_at"),
        F.col("value").alias("price_usd"),
        ((F.col("k") - 50) / F.lit(10.0)).alias("change_24h_pct"),
        (F.col("value") * 1e6).alias("turnover_24h_usd"),
        F.when(F.col("event_type") != "error", F.col("value") * (F.col("k") + 1) * 1000.0).alias("open_interest_usd"),
        F.when(F.col("event_type") != "view", (F.col("k") - 50) / F.lit(1e5)).alias("funding_rate"),
    )


def opportunity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan runs of twenty minutes; every seventh failed, every fifth degraded."""
    return runs_from(_events(spark, sf_dir))


def runs_from(events: DataFrame) -> DataFrame:
    run = F.floor(micros("ts") / RUN_WIDTH).cast("bigint")
    status = F.when(F.col("run_id") % 7 == 0, "failed").when(F.col("run_id") % 5 == 0, "degraded").otherwise("completed")
    return (
        events.groupBy(run.alias("run_id"))
        .agg(F.max("ts").alias("finished_at"))
        .withColumn("asset_class", F.lit("crypto"))
        .withColumn("status", status)
    )


def run_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members_from(_events(spark, sf_dir))


def members_from(events: DataFrame) -> DataFrame:
    """Instruments listed by a run: those with a purchase in it, at the price of the newest one."""
    n = F.col("user_id") % 20
    return (
        events.filter(F.col("event_type") == "purchase")
        .groupBy(
            F.floor(micros("ts") / RUN_WIDTH).cast("bigint").alias("run_id"),
            F.concat(F.lit("I"), n, F.lit("-USDT-SWAP")).alias("instrument_id"),
            F.concat(F.lit("I"), n).alias("symbol"),
        )
        .agg(F.max_by("value", "event_id").alias("price"))
    )


def listed_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument batch with listing metadata: one instrument per supplier, volumes from line items."""
    li = table(spark, sf_dir, "lineitem")
    traded = li.groupBy("l_suppkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("turnover"), F.sum("l_quantity").alias("quantity")
    )
    s = table(spark, sf_dir, "supplier")
    joined = s.join(traded, s["s_suppkey"] == traded["l_suppkey"], "left")
    suffix = F.when(F.col("s_suppkey") % 11 == 3, "-USD-SWAP").otherwise("-USDT-SWAP")
    return joined.select(
        F.concat(F.lit("S"), F.col("s_suppkey"), suffix).alias("instrument_id"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
        F.when(F.col("s_nationkey") % 3 == 0, "stock").otherwise("crypto").alias("asset_class"),
        F.col("s_acctbal").alias("price_usd"),
        F.col("turnover").alias("turnover_24h_usd"),
        F.when(F.col("s_suppkey") % 9 != 4, F.col("quantity") * 1000.0).alias("open_interest_usd"),
        F.when(F.col("s_suppkey") % 4 != 1, F.lit(0.0001)).alias("funding_rate"),
        F.timestamp_micros(F.lit(946684800000000) + F.col("s_suppkey") * DAY).alias("listed_at"),
        F.when(F.col("s_suppkey") % 13 != 7, F.lit(0.01)).alias("tick_size"),
    )


QUALITY_CYCLE = (q.FRESH, q.CACHED, q.DEGRADED, q.MISSING, q.FRESH)


def _cycled(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(level) for level in QUALITY_CYCLE]), (key % len(QUALITY_CYCLE)).cast("int") + 1)


def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged score inputs, one per event, with qualities that cycle through every level."""
    return score_inputs_from(_events(spark, sf_dir))


def score_inputs_from(events: DataFrame) -> DataFrame:
    k, e, v = F.col("k"), F.col("event_id"), F.col("value")

    def tag(value: Column, shift: int) -> Column:
        return q.tagged(value.cast("double"), _cycled(e + k + shift), "feed", F.col("ts"))

    return events.select(
        e.alias("snapshot_id"),
        F.col("user_id").cast("string").alias("token_id"),
        F.col("ts").alias("collected_at"),
        tag(v, 0).alias("price_usd"),
        tag(v * 100, 1).alias("liquidity_usd"),
        tag(v * (k + 1) * 10, 2).alias("market_cap_usd"),
        tag(v * k, 3).alias("volume_m5_usd"),
        tag(k % 17, 4).alias("buys_m5"),
        tag(k % 7, 0).alias("sells_m5"),
        tag(k % 11, 1).alias("buyers_m5"),
        tag((k % 50) / F.lit(10.0), 3).alias("buyer_velocity"),
        tag((k % 40) / F.lit(10.0), 3).alias("volume_velocity"),
        tag(v * (k % 5), 2).alias("buy_volume_m5_usd"),
        tag(v * (k % 3), 2).alias("sell_volume_m5_usd"),
        tag((k % 45) / F.lit(9.0), 4).alias("participant_growth"),
        tag(k % 6, 3).alias("social_momentum"),
        tag(k * 150, 0).alias("token_age_seconds"),
        tag(k, 1).alias("top10_holder_percent"),
        tag((k % 9 == 0).cast("int"), 2).alias("concentrated_activity"),
        tag((k % 8 == 0).cast("int"), 4).alias("suspected_bot_activity"),
        tag((k % 10 == 0).cast("int"), 0).alias("strong_dev_selling"),
    )
