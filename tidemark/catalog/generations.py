"""Queries on snapshot generations and token views."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import DAY, HOUR, micros
from tidemark.operators import generations as ge
from tidemark.operators.joins import asof_backward
from tidemark.sources import adapters as ad

# DEEP rows point at the FAST row that was newest two hours before them, so some bases are stale.
define("gen", """SELECT s.*, b.id AS base FROM (SELECT *, t - 7200000000 AS cut FROM snap) s ASOF LEFT JOIN (SELECT token_id, id, t FROM snap WHERE stage = 'FAST') b
  ON s.token_id = b.token_id AND s.cut >= b.t""", "snap")
define("lf", "SELECT token_id, max(id) AS lid FROM snap WHERE stage = 'FAST' GROUP BY 1", "snap")
define("cg", """SELECT g.* FROM gen g JOIN (SELECT l.token_id, coalesce(max(d.id), l.lid) AS cid FROM lf l LEFT JOIN (SELECT * FROM gen WHERE stage = 'DEEP') d
  ON d.token_id = l.token_id AND d.base = l.lid GROUP BY l.token_id, l.lid) c ON g.id = c.cid""", "gen", "lf")
define("tv", """SELECT c.*, p.id AS pid, c.raw_score - p.raw_score AS delta, CASE WHEN p.volume_m5_usd > 0 THEN (c.volume_m5_usd - p.volume_m5_usd) / p.volume_m5_usd * 100 END AS vchange,
  CASE WHEN c.buyers_m5 IS NOT NULL OR c.sellers_m5 IS NOT NULL THEN c.buyers_m5 ELSE c.aggregate_buyers_m5 END AS mb,
  CASE WHEN c.buyers_m5 IS NOT NULL OR c.sellers_m5 IS NOT NULL THEN c.sellers_m5 ELSE c.aggregate_sellers_m5 END AS ms
  FROM cg c LEFT JOIN snap p ON p.id = (SELECT arg_min(x.id, (x.t, x.id)) FROM snap x WHERE x.token_id = c.token_id AND x.t < c.t AND x.t >= c.t - 86400000000)""", "cg", "snap")
ORDER = """CASE effective_tier WHEN 'BREAKOUT' THEN 1 WHEN 'FAST_RISING' THEN 2 WHEN 'WATCH' THEN 3 ELSE 4 END, delta IS NULL, delta DESC NULLS LAST, raw_score DESC NULLS LAST,
  CASE evidence_confidence WHEN 'HIGH' THEN 1 WHEN 'GOOD' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, pool_created_t DESC NULLS LAST, t DESC, id DESC"""


def generations(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    fast = snaps.filter(F.col("stage") == "FAST")
    left = snaps.withColumn("__cut", F.timestamp_micros(micros("collected_at") - 2 * HOUR))
    return asof_backward(left, fast, ["token_id"], "__cut", "collected_at", ["id"], "id", into="b").select(
        *snaps.columns, F.col("b.id").alias("base_fast_snapshot_id")
    )


def views(spark, sf_dir):
    gen = generations(spark, sf_dir)
    return ge.token_views(ge.current_generation(gen), ad.snapshots(spark, sf_dir), DAY, DAY)


@query("j7_current_generation", oracle("SELECT token_id, id, stage FROM cg", "cg"))
def current_generation(spark, sf_dir):
    return ge.current_generation(generations(spark, sf_dir)).select("token_id", "id", "stage")


@query("p27_participants", oracle("""SELECT id, CAST(CASE WHEN buyers_m5 IS NOT NULL OR sellers_m5 IS NOT NULL THEN buyers_m5 ELSE aggregate_buyers_m5 END AS BIGINT) AS buyers,
  CASE WHEN buyers_m5 IS NOT NULL OR sellers_m5 IS NOT NULL THEN 'address_deduplicated' ELSE 'provider_aggregate' END AS evidence FROM snap""", "snap"))
def participants(spark, sf_dir):
    c = F.col
    p = ge.participants(c("buyers_m5"), c("sellers_m5"), c("aggregate_buyers_m5"), c("aggregate_sellers_m5"))
    return ad.snapshots(spark, sf_dir).select("id", p["buyers"].cast("bigint").alias("buyers"), p["evidence"].alias("evidence"))


@query("p28_token_views", oracle("SELECT token_id, pid AS previous_snapshot_id, delta AS score_delta, round(vchange, 6) AS volume_change_percent, round(CASE WHEN ms > 0 THEN mb / ms END, 6) AS buy_sell_ratio FROM tv", "tv"))
def token_views(spark, sf_dir):
    return views(spark, sf_dir).select(
        "token_id", "previous_snapshot_id", "score_delta", (F.round("volume_change_percent", 6) + 0.0).alias("volume_change_percent"),
        F.round("buy_sell_ratio", 6).alias("buy_sell_ratio"),
    )


@query("o1_radar", oracle(f"""SELECT token_id, effective_tier, delta AS score_delta, raw_score FROM tv WHERE effective_tier IN ('BREAKOUT','FAST_RISING')
  OR (effective_tier = 'WATCH' AND evidence_confidence IN ('HIGH','GOOD')) ORDER BY {ORDER} LIMIT 30""", "tv"))
def radar(spark, sf_dir):
    return ge.radar(views(spark, sf_dir)).select("token_id", "effective_tier", "score_delta", "raw_score")


@query("p26_radar_gate", oracle("""SELECT id FROM snap WHERE effective_tier IN ('BREAKOUT','FAST_RISING') OR (effective_tier = 'WATCH' AND evidence_confidence IN ('HIGH','GOOD'))""", "snap"))
def radar_gate(spark, sf_dir):
    return ad.snapshots(spark, sf_dir).filter(ge.radar_gate()).select("id")


@query("p24_archive_filter", oracle(f"""SELECT token_id, raw_score FROM tv WHERE chain = 'bsc' AND contains(lower(token_id), 'c:1') ORDER BY {ORDER} LIMIT 500""", "tv"))
def archive_filter(spark, sf_dir):
    named = views(spark, sf_dir).withColumns({"name": F.col("token_id"), "symbol": F.col("chain"), "address": F.col("token_id")})
    return ge.archive(named, " C:1 ", chain="BSC").select("token_id", "raw_score")


@query("p24_archive_by_tier", oracle(f"""SELECT token_id, raw_score FROM tv WHERE effective_tier = 'HIDDEN' AND evidence_confidence IN ('LOW') ORDER BY {ORDER} LIMIT 500""", "tv"))
def archive_by_tier(spark, sf_dir):
    return ge.archive(views(spark, sf_dir), effective_tier="hidden", evidence_confidence="low").select("token_id", "raw_score")


@query("p25_address_lookup", oracle("""SELECT a.address, CASE count(t.token_id) WHEN 1 THEN 'found' WHEN 0 THEN 'not_found' ELSE 'ambiguous' END AS state, CASE WHEN count(t.token_id) = 1 THEN min(t.token_id) END AS token_id
  FROM (SELECT DISTINCT upper('acc' || (c_custkey % 700)) AS address FROM customer) a LEFT JOIN (SELECT CASE c_custkey % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS chain, 'ACC' || (c_custkey % 900) AS address, c_name AS token_id FROM customer) t
  ON (t.chain = 'bsc' AND lower(t.address) = lower(a.address)) OR (t.chain = 'solana' AND t.address = a.address) GROUP BY 1"""))
def address_lookup(spark, sf_dir):
    cust = ad.table(spark, sf_dir, "customer")
    tokens = cust.select(
        F.when(F.col("c_custkey") % 2 == 0, "bsc").otherwise("solana").alias("chain"),
        F.concat(F.lit("ACC"), F.col("c_custkey") % 900).alias("address"), F.col("c_name").alias("token_id"),
    )
    asked = cust.select(F.upper(F.concat(F.lit("acc"), F.col("c_custkey") % 700)).alias("address"), F.lit(None).cast("string").alias("chain")).distinct()
    return ge.by_address(tokens, asked)


@query("t8_stale_generations", oracle("SELECT CASE WHEN stage = 'FAST' AND id < lid AND deep_status IN ('pending','queued','deferred') THEN 'stale' ELSE deep_status END AS deep_status, stage, count(*) AS snapshots FROM snap LEFT JOIN lf USING (token_id) GROUP BY 1, 2", "snap", "lf"))
def stale_generations(spark, sf_dir):
    return ge.mark_stale(ad.snapshots(spark, sf_dir)).groupBy("deep_status", "stage").agg(F.count(F.lit(1)).alias("snapshots"))


@query("t8_accepted_deep", oracle("""SELECT id, base FROM (SELECT g.*, f.id AS cur_base FROM (SELECT * FROM gen WHERE stage = 'DEEP') g ASOF LEFT JOIN (SELECT token_id, id, t FROM snap WHERE stage = 'FAST') f ON g.token_id = f.token_id AND g.t > f.t)
  WHERE base = cur_base QUALIFY row_number() OVER (PARTITION BY base ORDER BY id) = 1""", "gen"))
def accepted_deep(spark, sf_dir):
    gen = generations(spark, sf_dir)
    fast = ad.snapshots(spark, sf_dir).filter(F.col("stage") == "FAST")
    deep = asof_backward(gen.filter(F.col("stage") == "DEEP"), fast, ["token_id"], "collected_at", "collected_at", ["id"], "id", strict=True, into="c")
    return ge.accept_deep(deep.withColumn("current_base", F.col("c.id")), "current_base").select("id", F.col("base_fast_snapshot_id").alias("base"))


@query("j16_pending_deep", oracle("SELECT s.id, s.deep_status FROM snap s JOIN lf ON s.id = lf.lid WHERE deep_status IN ('pending','queued','deferred')", "snap", "lf"))
def pending_deep(spark, sf_dir):
    return ge.pending_deep(ad.snapshots(spark, sf_dir)).select("id", "deep_status")


@query("a8_generation_status", oracle("""SELECT count(*) FILTER (deep_status IN ('pending','queued','deferred')) AS deep_queued, count(*) FILTER (deep_status = 'completed') AS deep_completed,
  count(*) FILTER (deep_status = 'failed') AS deep_failed FROM snap s JOIN lf ON s.id = lf.lid""", "snap", "lf"))
def generation_status(spark, sf_dir):
    return ge.generation_status(ad.snapshots(spark, sf_dir))


@query("w23_score_change", oracle("""SELECT token_id, count(*) AS points, CASE WHEN count(*) >= 2 THEN arg_max(raw_score, (t, id)) - arg_min(raw_score, (t, id)) END AS score_change,
  CASE WHEN count(*) >= 2 THEN (max(t) - min(t)) // 1000000 END AS score_change_seconds, coalesce(count(*) >= 2 AND arg_max(raw_score, (t, id)) - arg_min(raw_score, (t, id)) <= -20, false) AS falling_fast
  FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY t DESC, id DESC) <= 40) GROUP BY 1""", "snap"))
def score_change(spark, sf_dir):
    return ge.score_change(ad.snapshots(spark, sf_dir), 40)


@query("w23_timeline", oracle("SELECT token_id, id, t AS at_us, raw_score FROM snap QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY t DESC, id DESC) <= 40", "snap"))
def timeline(spark, sf_dir):
    rows = ge.newest_per_token(ad.snapshots(spark, sf_dir), 40)
    return rows.select("token_id", "id", micros("collected_at").alias("at_us"), "raw_score")


@query("s12_recent_history", oracle("SELECT id, row_number() OVER (PARTITION BY token_id ORDER BY t DESC, id DESC) AS recency FROM snap QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY t DESC, id DESC) <= 12", "snap"))
def recent_history(spark, sf_dir):
    return ge.newest_per_token(ad.snapshots(spark, sf_dir), ge.HISTORY_LIMIT).select("id", F.col("recency").cast("bigint").alias("recency"))


@query("j6_history_before_cutoff", oracle("""SELECT s.id, row_number() OVER (PARTITION BY s.token_id ORDER BY s.t DESC, s.id DESC) AS recency FROM snap s JOIN (SELECT token_id, max(t) AS cutoff FROM snap WHERE raw_score >= 70 GROUP BY 1) c
  ON s.token_id = c.token_id AND s.t < c.cutoff QUALIFY row_number() OVER (PARTITION BY s.token_id ORDER BY s.t DESC, s.id DESC) <= 12""", "snap"))
def history_before_cutoff(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    cut = snaps.filter(F.col("raw_score") >= 70).groupBy("token_id").agg(F.max("collected_at").alias("cutoff"))
    return ge.newest_per_token(snaps, ge.HISTORY_LIMIT, cut).select("id", F.col("recency").cast("bigint").alias("recency"))


@query("p30_provider_status", oracle("""SELECT o_orderkey AS run_id, CASE WHEN contains(lower(o_orderpriority), 'high') THEN 'degraded' WHEN o_orderstatus IN ('F','O') THEN 'healthy' ELSE 'unknown' END AS provider FROM orders"""))
def provider_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "degraded").otherwise("failed")
    return ad.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), ge.provider_status(status, F.col("o_orderpriority"), "HIGH").alias("provider")
    )


@query("p31_latest_coverage", oracle("""SELECT chain, id, CASE WHEN newest >= oldest THEN (newest - oldest) // 1000000 END AS duration_seconds FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 'bsc' WHEN 1 THEN 'solana' ELSE 'base' END AS chain, o_orderkey AS id,
  epoch_us(o_orderdate) AS started, epoch_us(o_orderdate) + (o_orderkey % 5 - 1) * 3600000000 AS newest, epoch_us(o_orderdate) AS oldest FROM orders) QUALIFY row_number() OVER (PARTITION BY chain ORDER BY started DESC, id DESC) = 1"""))
def latest_coverage(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    cov = o.select(
        ad.chain_of(F.col("o_custkey")).alias("chain"), F.col("o_orderkey").alias("id"), at.alias("scan_started_at"),
        F.timestamp_micros(micros(at) + (F.col("o_orderkey") % 5 - 1) * HOUR).alias("newest_pool_at"), at.alias("oldest_pool_at"),
    )
    return ge.latest_coverage(cov).select("chain", "id", "duration_seconds")


@query("p9_pool_age", oracle("SELECT id, CASE WHEN pool_created_t <= t THEN (t - pool_created_t) // 1000000 END AS pool_age_seconds FROM snap", "snap"))
def pool_age(spark, sf_dir):
    age = ge.age_or_null(F.col("collected_at"), F.col("discovery_pool_created_at"))
    return ad.snapshots(spark, sf_dir).select("id", age.alias("pool_age_seconds"))


@query("s11_study_source", oracle("""SELECT s.id, x.score_version, x.role, x.raw_score, v.tier_count FROM snap s LEFT JOIN scores x ON x.id = s.id LEFT JOIN (VALUES ('V1', 3)) v(score_version, tier_count) ON v.score_version = x.score_version
  WHERE s.id > -1 AND s.id <= (SELECT max(id) FROM snap)""", "snap", "scores"))
def study_source(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    scores = ad.snapshot_scores(spark, sf_dir).select(F.col("id").alias("snapshot_id"), "score_version", "role", F.col("raw_score").alias("version_score"))
    versions = spark.createDataFrame([("V1", 3)], "score_version string, tier_count int")
    top = snaps.agg(F.max("id").alias("m")).select("m").scalar()
    return ge.study_source(snaps, scores, versions, F.lit(-1), top).select("id", "score_version", "role", F.col("version_score").alias("raw_score"), "tier_count")
