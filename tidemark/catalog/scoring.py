"""Queries on scalar rules and score evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions import quality as q
from tidemark.functions.timecol import DAY
from tidemark.operators import scoring as sc
from tidemark.operators.joins import previous_row
from tidemark.functions.timecol import bucket_of, micros
from tidemark.sources import adapters as ad

TAGS = (
    ("price_usd", "value", 0), ("liquidity_usd", "value * 100", 1), ("market_cap_usd", "value * (k + 1) * 10", 2),
    ("volume_m5_usd", "value * k", 3), ("buys_m5", "k % 17", 4), ("sells_m5", "k % 7", 0), ("buyers_m5", "k % 11", 1),
    ("buyer_velocity", "(k % 50) / CAST(10 AS DOUBLE)", 3), ("volume_velocity", "(k % 40) / CAST(10 AS DOUBLE)", 3),
    ("buy_volume_m5_usd", "value * (k % 5)", 2), ("sell_volume_m5_usd", "value * (k % 3)", 2),
    ("participant_growth", "(k % 45) / CAST(9 AS DOUBLE)", 4), ("social_momentum", "k % 6", 3), ("token_age_seconds", "k * 150", 0),
    ("top10_holder_percent", "k", 1), ("concentrated_activity", "CAST(k % 9 = 0 AS INTEGER)", 2),
    ("suspected_bot_activity", "CAST(k % 8 = 0 AS INTEGER)", 4), ("strong_dev_selling", "CAST(k % 10 = 0 AS INTEGER)", 0),
)
_cols = ",\n".join(
    f"CASE WHEN (event_id + k + {s}) % 5 <> 3 THEN CAST({e} AS DOUBLE) END AS {n},"
    f"CASE (event_id + k + {s}) % 5 WHEN 1 THEN 'cached' WHEN 2 THEN 'degraded' WHEN 3 THEN 'missing' ELSE 'fresh' END AS {n}_q"
    for n, e, s in TAGS
)
define("si0", f"SELECT event_id AS snapshot_id, CAST(user_id AS VARCHAR) AS token_id, t, {_cols} FROM ev", "ev")
define("si", """SELECT *, lag(buyers_m5) OVER w AS prev_buyers, lag(buyers_m5_q) OVER w AS prev_buyers_q,
  lag(volume_m5_usd) OVER w AS prev_volume, lag(volume_m5_usd_q) OVER w AS prev_volume_q
  FROM si0 WINDOW w AS (PARTITION BY token_id ORDER BY t, snapshot_id)""", "si0")


def sql_ratio(n, d):
    return f"CASE WHEN {n} IS NULL OR {d} IS NULL OR {d} < 0 THEN NULL WHEN {d} = 0 AND {n} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {d} = 0 THEN 0 ELSE {n} / {d} END"


def sql_ladder(x, m, t=(4, 3, 2, 1.5, 1.1), p=(1, .85, .65, .45, .25)):
    steps = " ".join(f"WHEN {x} >= CAST({a} AS DOUBLE) THEN {m} * CAST({b} AS DOUBLE)" for a, b in zip(t, p))
    return f"CASE WHEN {x} IS NULL THEN NULL {steps} ELSE 0 END"


LIQ = (.20, .10, .05, .02, .01)
define("ratios", f"""SELECT *, coalesce(buyer_velocity, {sql_ratio('buyers_m5', 'prev_buyers')}) AS r_bv,
  coalesce(volume_velocity, {sql_ratio('volume_m5_usd', 'prev_volume')}) AS r_vv,
  {sql_ratio('buys_m5', 'sells_m5')} AS r_tx, {sql_ratio('buy_volume_m5_usd', 'sell_volume_m5_usd')} AS r_vol,
  {sql_ratio('liquidity_usd', 'market_cap_usd')} AS r_lq FROM si""", "si")


def points_sql(maxima, tiers, velocity=(4, 3, 2, 1.5, 1.1)):
    bv, vv, bp, pg, so, lq = maxima
    L = lambda x, m: sql_ladder(x, m, velocity)
    return f"""SELECT *, {L('r_bv', bv)} AS p_bv, {L('r_vv', vv)} AS p_vv,
  CASE WHEN r_tx IS NOT NULL AND r_vol IS NOT NULL THEN (({L('r_tx', bp)}) + ({L('r_vol', bp)})) / 2
       ELSE coalesce({L('r_tx', bp)}, {L('r_vol', bp)}) END AS p_bp,
  {L('participant_growth', pg)} AS p_pg, {L('social_momentum', so)} AS p_so, {sql_ladder('r_lq', lq, LIQ)} AS p_lq FROM ratios"""


def totals_sql(src, maxima):
    names = ("bv", "vv", "bp", "pg", "so", "lq")
    raw = " + ".join(f"coalesce(p_{n}, 0)" for n in names)
    top = " + ".join(f"CASE WHEN p_{n} IS NULL THEN 0 ELSE {m} END" for n, m in zip(names, maxima))
    cnt = " + ".join(f"CAST(p_{n} IS NOT NULL AS INTEGER)" for n in names if n != "so")
    return f"""SELECT *, CAST({raw} AS DOUBLE) AS raw_momentum, CAST({top} AS DOUBLE) AS available_maximum, {cnt} AS evidence_available,
  CASE WHEN token_age_seconds / 60 <= 30 THEN 10 WHEN token_age_seconds / 60 <= 60 THEN 6 WHEN token_age_seconds / 60 <= 120 THEN 2 ELSE 0 END AS age_bonus,
  CASE WHEN top10_holder_percent > 80 THEN 30 WHEN top10_holder_percent > 60 THEN 15 ELSE 0 END AS k1,
  CASE WHEN liquidity_usd < 2000 THEN 20 WHEN liquidity_usd <= 5000 THEN 10 ELSE 0 END AS k2,
  CASE WHEN concentrated_activity = 1 THEN 15 ELSE 0 END AS k3, CASE WHEN suspected_bot_activity = 1 THEN 15 ELSE 0 END AS k4,
  CASE WHEN strong_dev_selling = 1 THEN 20 ELSE 0 END AS k5 FROM ({src})"""


def final_sql(src, version, role):
    return f"""SELECT *, CASE WHEN evidence_confidence = 'MEDIUM' AND raw_tier = 'BREAKOUT' THEN 'FAST_RISING'
    WHEN evidence_confidence = 'LOW' AND raw_tier IN ('BREAKOUT','FAST_RISING') THEN 'WATCH' ELSE raw_tier END AS effective_tier
  FROM (SELECT *, CASE WHEN raw_score >= 85 THEN 'BREAKOUT' WHEN raw_score >= 70 THEN 'FAST_RISING' WHEN raw_score >= 55 THEN 'WATCH' ELSE 'HIDDEN' END AS raw_tier,
    CASE evidence_available WHEN 5 THEN 'HIGH' WHEN 4 THEN 'GOOD' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS evidence_confidence
  FROM (SELECT *, k1 + k2 + k3 + k4 + k5 AS risk_penalty, '{version}' AS score_version, '{role}' AS role,
    CASE WHEN available_maximum > 0 THEN raw_momentum / available_maximum * 100 ELSE 0 END AS normalized_momentum,
    least(greatest(CASE WHEN available_maximum > 0 THEN raw_momentum / available_maximum * 100 ELSE 0 END + age_bonus - (k1 + k2 + k3 + k4 + k5), 0), 100) AS raw_score
  FROM ({src})))"""


V1_MAX = (25, 20, 15, 15, 15, 10)
V2_MAX = (40, 20, 15, 15, 15, 10)
V2 = sc.variant("SCORE_V1.1", factors__buyer_velocity__maximum=40.0)
V3 = sc.variant("SCORE_V1.2", factors__social_momentum__maximum=5.0)
define("pts1", points_sql(V1_MAX, None), "ratios")
define("sc1", final_sql(totals_sql("SELECT * FROM pts1", V1_MAX), "SCORE_V1.0", "CHAMPION"), "pts1")
define("pts2", points_sql(V2_MAX, None), "ratios")
define("sc2", final_sql(totals_sql("SELECT * FROM pts2", V2_MAX), "SCORE_V1.1", "CHALLENGER"), "pts2")


def inputs(spark, sf_dir):
    """Score inputs with the token's previous snapshot attached."""
    df = ad.score_inputs(spark, sf_dir)
    with_prev = previous_row(
        df, ["token_id"], ["collected_at", "snapshot_id"], ["buyers_m5", "volume_m5_usd"],
        bucket_of(micros("collected_at"), DAY), "__previous",
    )
    return (
        with_prev.withColumn("prev_buyers_m5", F.col("__previous.buyers_m5"))
        .withColumn("prev_volume_m5_usd", F.col("__previous.volume_m5_usd")).drop("__previous")
    )


def scored(spark, sf_dir, *challengers):
    ready = sc.with_previous(ad.score_inputs(spark, sf_dir), ["token_id"], ["collected_at", "snapshot_id"], bucket_of(micros("collected_at"), DAY))
    return sc.score(ready, sc.default_config(), challengers)


@query("c1_score_evaluation", oracle("""SELECT snapshot_id, round(raw_momentum, 6) AS raw_momentum, available_maximum,
  round(normalized_momentum, 6) AS normalized_momentum, CAST(age_bonus AS DOUBLE) AS age_bonus, CAST(risk_penalty AS DOUBLE) AS risk_penalty,
  round(raw_score, 6) AS raw_score, raw_tier FROM sc1""", "sc1"))
def score_evaluation(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "snapshot_id", F.round("raw_momentum", 6).alias("raw_momentum"), "available_maximum",
        F.round("normalized_momentum", 6).alias("normalized_momentum"), "age_bonus", "risk_penalty",
        F.round("raw_score", 6).alias("raw_score"), "raw_tier",
    )


_fac = {"bv": "buyer_velocity", "vv": "volume_velocity", "bp": "buy_pressure", "pg": "participant_growth", "so": "social_momentum", "lq": "liquidity_quality"}


@query("c2_factor_points", oracle("SELECT snapshot_id, " + ", ".join(
    f"round(CAST(p_{s} AS DOUBLE), 6) AS {n}" for s, n in _fac.items()) + " FROM pts1", "pts1"))
def factor_points(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.select(
        "snapshot_id",
        *[F.when(F.col("factors")[n]["available"], F.round(F.col("factors")[n]["points"], 6)).alias(n) for n in _fac.values()],
    )


@query("c3_age_bonus", oracle("SELECT age_bonus, count(*) AS snapshots FROM (SELECT snapshot_id, CAST(age_bonus AS DOUBLE) AS age_bonus FROM sc1) GROUP BY 1", "sc1"))
def age_bonus(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("age_bonus").agg(F.count(F.lit(1)).alias("snapshots"))


@query("c4_risk_penalty", oracle("""SELECT snapshot_id, CAST(risk_penalty AS DOUBLE) AS risk_penalty, concat_ws(',',
  CASE WHEN k1 > 0 THEN 'HIGH_CONCENTRATION' END, CASE WHEN k2 > 0 THEN 'LOW_LIQUIDITY' END, CASE WHEN k3 > 0 THEN 'CONCENTRATED_ACTIVITY' END,
  CASE WHEN k4 > 0 THEN 'SUSPECTED_BOT_ACTIVITY' END, CASE WHEN k5 > 0 THEN 'STRONG_DEV_SELLING' END) AS risk_flags FROM sc1""", "sc1"))
def risk_penalty(spark, sf_dir):
    return scored(spark, sf_dir).select("snapshot_id", "risk_penalty", F.array_join("risk_flags", ",").alias("risk_flags"))


@query("c5_evidence_gate", oracle("""SELECT snapshot_id, CAST(evidence_available AS BIGINT) AS evidence_available, evidence_confidence,
  raw_tier, effective_tier FROM sc1""", "sc1"))
def evidence_gate(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "snapshot_id", F.col("evidence_available").cast("bigint").alias("evidence_available"), "evidence_confidence",
        "raw_tier", "effective_tier",
    )


@query("c6_tier_distribution", oracle("SELECT raw_tier, count(*) AS snapshots, round(min(raw_score), 6) AS lowest FROM sc1 GROUP BY 1", "sc1"))
def tier_distribution(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("raw_tier").agg(
        F.count(F.lit(1)).alias("snapshots"), F.round(F.min("raw_score"), 6).alias("lowest")
    )


def _worst(own, a, b):
    return f"""CASE WHEN {own} <> 'missing' THEN {own} WHEN coalesce({a}, 'missing') = 'missing' OR coalesce({b}, 'missing') = 'missing' THEN 'missing'
  WHEN 'degraded' IN ({a}, {b}) THEN 'degraded' WHEN 'cached' IN ({a}, {b}) THEN 'cached' ELSE 'fresh' END"""


@query("c7_evidence_quality", oracle(f"""SELECT snapshot_id, {_worst('buyer_velocity_q', 'buyers_m5_q', 'prev_buyers_q')} AS buyer_velocity,
  {_worst('volume_velocity_q', 'volume_m5_usd_q', 'prev_volume_q')} AS volume_velocity, token_age_seconds_q AS token_age,
  top10_holder_percent_q AS top10_holder_percent, 11 AS keys FROM si""", "si"))
def evidence_quality(spark, sf_dir):
    m = F.col("evidence_quality")
    return scored(spark, sf_dir).select(
        "snapshot_id", m["buyer_velocity"].alias("buyer_velocity"), m["volume_velocity"].alias("volume_velocity"),
        m["token_age"].alias("token_age"), m["top10_holder_percent"].alias("top10_holder_percent"), F.size(m).alias("keys"),
    )


@query("c8_multi_version_scores", oracle("""SELECT snapshot_id, score_version, role, round(raw_score, 6) AS raw_score, effective_tier FROM sc1
  UNION ALL SELECT snapshot_id, score_version, role, round(raw_score, 6), effective_tier FROM sc2""", "sc1", "sc2"))
def multi_version_scores(spark, sf_dir):
    return scored(spark, sf_dir, V2).select(
        "snapshot_id", "score_version", "role", F.round("raw_score", 6).alias("raw_score"), "effective_tier"
    )


V4 = sc.variant("SCORE_V1.3", tiers__watch=20.0)
define("sc3", final_sql(totals_sql(f"SELECT * FROM ({points_sql((25, 20, 15, 15, 5, 10), None)})", (25, 20, 15, 15, 5, 10)), "SCORE_V1.2", "CHALLENGER"), "ratios")
define("sc4", final_sql(totals_sql("SELECT * FROM pts1", V1_MAX), "SCORE_V1.3", "CHALLENGER").replace("raw_score >= 55", "raw_score >= 20"), "pts1")


@query("c8_four_versions", oracle(" UNION ALL ".join(
    f"SELECT snapshot_id, score_version, role, round(raw_score, 6) AS raw_score, raw_tier, effective_tier FROM {t}" for t in ("sc1", "sc2", "sc3", "sc4")), "sc1", "sc2", "sc3", "sc4"))
def four_versions(spark, sf_dir):
    return scored(spark, sf_dir, V4, V2, V3).select(
        "snapshot_id", "score_version", "role", F.round("raw_score", 6).alias("raw_score"), "raw_tier", "effective_tier"
    )


@query("p3_evidence_ratio", oracle("""SELECT snapshot_id, CASE WHEN isinf(r_tx) THEN -1 ELSE round(r_tx, 8) END AS trade_ratio,
  CASE WHEN isinf(r_lq) THEN -1 ELSE round(r_lq, 8) END AS liquidity_ratio FROM ratios""", "ratios"))
def evidence_ratio(spark, sf_dir):
    df = ad.score_inputs(spark, sf_dir)
    show = lambda c: F.when(c == float("inf"), F.lit(-1.0)).otherwise(F.round(c, 8))
    return df.select(
        "snapshot_id", show(q.evidence_ratio(F.col("buys_m5"), F.col("sells_m5"))).alias("trade_ratio"),
        show(q.evidence_ratio(F.col("liquidity_usd"), F.col("market_cap_usd"))).alias("liquidity_ratio"),
    )


@query("p2_quality_counts", oracle("""SELECT price_usd_q AS quality, price_usd_q <> 'missing' AS available, count(*) AS snapshots, count(price_usd) AS with_value
  FROM si0 GROUP BY 1, 2""", "si0"))
def quality_counts(spark, sf_dir):
    df = ad.score_inputs(spark, sf_dir)
    return df.groupBy(
        q.canonical_quality(F.col("price_usd.quality")).alias("quality"), q.available(F.col("price_usd")).alias("available")
    ).agg(F.count(F.lit(1)).alias("snapshots"), F.count("price_usd.value").alias("with_value"))


@query("p5_velocity_ladder", oracle(f"""SELECT round(x, 6) AS velocity, round(CAST({sql_ladder('x', 25)} AS DOUBLE), 6) AS points, count(*) AS n
  FROM (SELECT buyer_velocity AS x FROM si0 WHERE buyer_velocity IS NOT NULL) GROUP BY 1, 2""", "si0"))
def velocity_ladder(spark, sf_dir):
    df = ad.score_inputs(spark, sf_dir).filter(q.available(F.col("buyer_velocity")))
    v = F.col("buyer_velocity.value")
    return df.groupBy(F.round(v, 6).alias("velocity"), F.round(q.ladder(v, q.VELOCITY_LADDER, 25.0), 6).alias("points")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("p6_liquidity_ladder", oracle(f"""SELECT round(CAST({sql_ladder('r_lq', 10, LIQ)} AS DOUBLE), 6) AS points, count(*) AS n
  FROM ratios GROUP BY 1""", "ratios"))
def liquidity_ladder(spark, sf_dir):
    r = q.evidence_ratio(F.col("liquidity_usd"), F.col("market_cap_usd"))
    points = F.when(r.isNotNull(), F.round(q.ladder(r, q.LIQUIDITY_LADDER, 10.0), 6))
    return ad.score_inputs(spark, sf_dir).groupBy(points.alias("points")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_prefer_tagged", oracle("""SELECT snapshot_id, round(CASE WHEN buy_volume_m5_usd_q <> 'missing' THEN buy_volume_m5_usd ELSE volume_m5_usd END, 6) AS value,
  CASE WHEN buy_volume_m5_usd_q <> 'missing' THEN buy_volume_m5_usd_q ELSE volume_m5_usd_q END AS quality FROM si0""", "si0"))
def prefer_tagged(spark, sf_dir):
    both = q.prefer(F.col("buy_volume_m5_usd"), F.col("volume_m5_usd"))
    return ad.score_inputs(spark, sf_dir).select(
        "snapshot_id", F.round(both["value"], 6).alias("value"), both["quality"].alias("quality")
    )


@query("w24_previous_snapshot", oracle("""SELECT snapshot_id, prev_buyers_q AS previous_quality, round(prev_volume, 6) AS previous_volume FROM si""", "si"))
def previous_snapshot(spark, sf_dir):
    return inputs(spark, sf_dir).select(
        "snapshot_id", F.col("prev_buyers_m5.quality").alias("previous_quality"),
        F.round("prev_volume_m5_usd.value", 6).alias("previous_volume"),
    )
