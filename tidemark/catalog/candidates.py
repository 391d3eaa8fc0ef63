"""Queries on discovery candidates and the active universe."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions import quality as q
from tidemark.functions.identity import token_id
from tidemark.functions.timecol import HOUR, MINUTE, micros
from tidemark.operators import candidates as ca
from tidemark.sources import adapters as ad

define("cand", """SELECT o_orderkey AS seq, CASE o_custkey % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS chain, 'Acc' || o_custkey AS address,
  CASE o_custkey % 2 WHEN 0 THEN 'bsc:acc' ELSE 'solana:Acc' END || o_custkey AS token_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS name,
  CASE o_orderstatus WHEN 'O' THEN 'LAUNCH' WHEN 'F' THEN 'MOMENTUM' ELSE 'LAUNCH' END AS origin,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'GECKO_TRENDING' WHEN '2' THEN 'GECKO_TOP_VOLUME' WHEN '3' THEN 'DEX_BOOST_TOP' WHEN '4' THEN 'LOCAL_UNIVERSE' END AS source,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'pool' || (o_orderkey % 50) ELSE '' END AS pool, epoch_us(o_orderdate) AS t, o_totalprice AS price,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 10 END AS liquidity, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * (o_orderkey % 9) END AS cap FROM orders""")


def candidates(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    first = F.substring("o_orderpriority", 1, 1)
    source = F.when(first == "1", ca.SOURCE_TRENDING).when(first == "2", ca.SOURCE_TOP_VOLUME).when(first == "3", ca.SOURCE_BOOST).when(first == "4", ca.SOURCE_LOCAL)
    at = F.col("o_orderdate").cast("timestamp")
    pool = F.when(k % 4 != 0, F.concat(F.lit("pool"), k % 50)).otherwise("")
    liquidity = F.when(k % 5 != 0, F.col("o_totalprice") / 10)
    cap = F.when(k % 7 != 0, F.col("o_totalprice") * (k % 9))
    return o.select(
        k.alias("seq"), F.when(cust % 2 == 0, "bsc").otherwise("solana").alias("chain"), F.concat(F.lit("Acc"), cust).alias("address"),
        F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"), F.lit("").alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "MOMENTUM").when(F.col("o_orderstatus") == "O", "LAUNCH").otherwise("").alias("origin"),
        F.array_compact(F.array(source)).alias("momentum_sources"), source.alias("source"),
        pool.alias("pair_address"), pool.alias("discovery_pool_address"), at.alias("discovery_pool_created_at"),
        F.lit("").alias("trigger_pool_address"), F.lit(None).cast("timestamp").alias("trigger_pool_created_at"),
        F.lit(None).cast("timestamp").alias("chain_created_at"), at.alias("detected_at"),
        F.col("o_totalprice").alias("price"), liquidity.alias("liquidity"), cap.alias("cap"),
        F.struct(
            F.when(k % 2 == 0, "full").otherwise("partial").alias("market_data_quality"),
            (F.lit(1) + liquidity.isNotNull().cast("int") + cap.isNotNull().cast("int")).alias("evidence_count"),
            at.alias("collected_at"), pool.alias("pair_address"), F.col("o_totalprice").alias("price"),
        ).alias("market"),
    )


@query("c11_candidate_merge", oracle("""SELECT token_id, CASE WHEN min(origin) = max(origin) THEN min(origin) ELSE 'BOTH' END AS origin, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources,
  arg_min(name, seq) FILTER (name <> '') AS name, arg_min(pool, seq) FILTER (pool <> '') AS discovery_pool_address,
  coalesce(arg_max(pool, seq) FILTER (pool <> '' AND origin <> 'LAUNCH'), arg_min(pool, seq) FILTER (pool <> '')) AS pair_address, min(t) AS detected_us,
  arg_max(price, (CASE seq % 2 WHEN 0 THEN 2 ELSE 1 END, 1 + CAST(liquidity IS NOT NULL AS INTEGER) + CAST(cap IS NOT NULL AS INTEGER), t, pool, -seq)) AS market_price, count(*) AS observations FROM cand GROUP BY 1""", "cand"))
def candidate_merge(spark, sf_dir):
    m = ca.merge_candidates(candidates(spark, sf_dir), "seq")
    return m.select(
        "token_id", "origin", F.array_join("momentum_sources", ",").alias("sources"), "name", "discovery_pool_address", "pair_address",
        micros("detected_at").alias("detected_us"), F.col("market.price").alias("market_price"), "observations",
    )


@query("p1_token_identity", oracle("SELECT token_id, count(*) AS observations FROM cand GROUP BY 1", "cand"))
def token_identity(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy(token_id(F.col("chain"), F.col("address")).alias("token_id")).agg(F.count(F.lit(1)).alias("observations"))


@query("u3_first_per_token", oracle("SELECT token_id, min(seq) AS seq FROM cand GROUP BY 1", "cand"))
def first_per_token(spark, sf_dir):
    return ca.first_per_token(ca.normalize(candidates(spark, sf_dir)), ["seq"]).select("token_id", "seq")


@query("u1_source_union", oracle("SELECT 'launch' AS feed, count(*) AS n, count(DISTINCT token_id) AS tokens FROM cand WHERE origin = 'LAUNCH' UNION ALL SELECT 'momentum', count(*), count(DISTINCT token_id) FROM cand WHERE origin = 'MOMENTUM'", "cand"))
def source_union(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir))
    launch = c.filter(F.col("origin") == "LAUNCH").withColumn("feed", F.lit("launch"))
    momentum = c.filter(F.col("origin") == "MOMENTUM").withColumn("feed", F.lit("momentum"))
    both = launch.unionByName(momentum, allowMissingColumns=True)
    return both.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token_id").alias("tokens"))


@query("u2_distinct_sources", oracle("SELECT seq, array_to_string(list_sort(list_distinct([x FOR x IN [source, 'LOCAL_UNIVERSE'] IF x IS NOT NULL])), ',') AS sources FROM cand", "cand"))
def distinct_sources(spark, sf_dir):
    both = F.array_union(F.col("momentum_sources"), F.array(F.lit(ca.SOURCE_LOCAL)))
    return candidates(spark, sf_dir).select("seq", F.array_join(ca.distinct_sorted(both), ",").alias("sources"))


@query("p17_admission_source", oracle("""SELECT CASE WHEN source IN ('GECKO_TOP_VOLUME','LOCAL_UNIVERSE') THEN 'ANOMALY' WHEN origin = 'MOMENTUM' THEN 'TRENDING' ELSE 'HISTORICAL' END AS admission_source, count(*) AS candidates FROM cand GROUP BY 1""", "cand"))
def admission(spark, sf_dir):
    s = ca.admission_source(F.col("momentum_sources"), F.col("origin"))
    return candidates(spark, sf_dir).groupBy(s.alias("admission_source")).agg(F.count(F.lit(1)).alias("candidates"))


@query("a6_source_report", oracle("""SELECT seq // 50 AS run_id, chain, coalesce(source, 'NONE') AS source, count(*) AS returned_items, count(DISTINCT token_id) FILTER (pool <> '') AS unique_candidates,
  arg_min('no pool ' || seq, seq) FILTER (pool = '') AS first_error FROM cand GROUP BY 1, 2, 3""", "cand"))
def source_report(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir)).withColumn("source", F.coalesce("source", F.lit("NONE"))).withColumn("run_id", F.floor(F.col("seq") / 50))
    c = c.withColumn("error", F.when(F.col("pair_address") == "", F.concat(F.lit("no pool "), F.col("seq"))))
    return ca.source_report(c)


@query("a5_discovery_coverage", oracle("SELECT seq // 50 AS run_id, chain, max(t) AS newest_us, min(t) AS oldest_us, count(DISTINCT seq % 3) AS pages_fetched, count(DISTINCT token_id) FILTER (seq % 4 <> 0) AS unique_candidates FROM cand GROUP BY 1, 2", "cand"))
def discovery_coverage(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir)).withColumn("page", F.col("seq") % 3).withColumn("pool_created_at", F.col("discovery_pool_created_at"))
    c = c.withColumn("run_id", F.floor(F.col("seq") / 50)).withColumn("kept", F.col("seq") % 4 != 0)
    return ca.discovery_coverage(c).select(
        "run_id", "chain", micros("newest_pool_at").alias("newest_us"), micros("oldest_pool_at").alias("oldest_us"), "pages_fetched", "unique_candidates"
    )


@query("a3_best_pair", oracle("SELECT token_id, arg_max(seq, (liquidity, -seq)) FILTER (liquidity IS NOT NULL) AS seq, max(liquidity) AS liquidity_usd, min(t) AS earliest_us FROM cand GROUP BY 1 HAVING max(liquidity) IS NOT NULL", "cand"))
def best_pair(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir)).withColumn("liquidity_usd", F.col("liquidity")).withColumn("pair_created_at", F.col("detected_at"))
    return ca.best_pairs(c, "seq").select("token_id", "seq", "liquidity_usd", micros("earliest_pair_at").alias("earliest_us"))


@query("a4_earliest_pair_age", oracle("SELECT token_id, greatest(0, (SELECT max(t) FROM cand) - min(t)) // 1000000 AS age_seconds FROM cand GROUP BY 1", "cand"))
def earliest_pair_age(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir))
    now = c.agg(F.max("detected_at").alias("t")).select("t").scalar()
    per = c.groupBy("token_id").agg(F.min("detected_at").alias("t"))
    return per.select("token_id", (ca.token_age(now, F.col("t")) / 1_000_000).cast("bigint").alias("age_seconds"))


@query("j10_wanted_pairs", oracle("SELECT seq FROM cand WHERE token_id IN (SELECT token_id FROM cand WHERE source = 'DEX_BOOST_TOP')", "cand"))
def wanted_pairs(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir))
    return ca.wanted_pairs(c, c.filter(F.col("source") == ca.SOURCE_BOOST)).select("seq")


@query("a7_origin_distribution", oracle("SELECT origin AS level, count(*) AS candidates FROM (SELECT token_id, CASE WHEN min(origin) = max(origin) THEN min(origin) ELSE 'BOTH' END AS origin FROM cand GROUP BY 1) GROUP BY 1", "cand"))
def origin_distribution(spark, sf_dir):
    return ca.distribution(ca.merge_candidates(candidates(spark, sf_dir), "seq"), "origin")


# ---- universe -----------------------------------------------------------------------------------

define("uobs", """SELECT *, CASE WHEN source IN ('GECKO_TOP_VOLUME','LOCAL_UNIVERSE') THEN 'ANOMALY' WHEN origin = 'MOMENTUM' THEN 'TRENDING' ELSE 'HISTORICAL' END AS adm FROM cand""", "cand")
define("uev", """SELECT chain, token_id, max(CASE adm WHEN 'ANOMALY' THEN 300 WHEN 'TRENDING' THEN 200 ELSE 100 END) AS prio, min(t) AS first_t, max(t) AS seen_t, max(t) FILTER (adm <> 'HISTORICAL') AS mom_t,
  max(t) FILTER (seq % 3 = 0) AS trade_t, arg_max(liquidity, (t, seq)) FILTER (liquidity IS NOT NULL) AS liq, arg_max(price, (t, seq)) AS vol FROM uobs GROUP BY 1, 2""", "uobs")
STRENGTH = "mom_t DESC NULLS LAST, trade_t DESC NULLS LAST, liq DESC NULLS LAST, vol DESC NULLS LAST, seen_t DESC, token_id DESC"


def universe_evidence(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir))
    obs = c.select(
        "chain", "token_id", "seq", F.col("detected_at").alias("observed_at"),
        ca.admission_source(F.col("momentum_sources"), F.col("origin")).alias("admission_source"),
        F.when(F.col("seq") % 3 == 0, F.col("detected_at")).alias("last_trade_at"),
        F.col("liquidity").alias("liquidity_usd"), F.col("price").alias("volume_h24_usd"),
    )
    return ca.merge_universe_evidence(obs)


@query("t7_universe_evidence", oracle("SELECT token_id, CAST(prio AS BIGINT) AS admission_priority, seen_t AS last_seen_us, mom_t AS last_momentum_us, trade_t AS last_trade_us, round(liq, 4) AS liquidity_usd FROM uev", "uev"))
def universe_evidence_query(spark, sf_dir):
    return universe_evidence(spark, sf_dir).select(
        "token_id", F.col("admission_priority").cast("bigint").alias("admission_priority"), micros("last_seen_at").alias("last_seen_us"),
        micros("last_momentum_at").alias("last_momentum_us"), micros("last_trade_at").alias("last_trade_us"), F.round("liquidity_usd", 4).alias("liquidity_usd"),
    )


@query("o7_bounded_universe", oracle(f"SELECT chain, token_id FROM uev QUALIFY row_number() OVER (PARTITION BY chain ORDER BY {STRENGTH}) <= 300", "uev"))
def bounded_universe(spark, sf_dir):
    return ca.bounded_universe(universe_evidence(spark, sf_dir), 300).select("chain", "token_id")


@query("j11_seed_from_history", oracle(f"""SELECT token_id FROM (SELECT u.*, row_number() OVER (PARTITION BY chain ORDER BY prio > 100 DESC, seen_t DESC, liq DESC NULLS LAST, vol DESC NULLS LAST, token_id DESC) AS rn FROM uev u
  WHERE token_id NOT IN (SELECT token_id FROM uev QUALIFY row_number() OVER (PARTITION BY chain ORDER BY {STRENGTH}) <= 300)) JOIN (SELECT chain, least(300, count(*)) AS have FROM uev GROUP BY 1) USING (chain) WHERE rn <= greatest(0, 400 - have)""", "uev"))
def seed_from_history(spark, sf_dir):
    ev = universe_evidence(spark, sf_dir)
    members = ca.bounded_universe(ev, 300)
    tokens = ev.select(
        "chain", "token_id", F.when(F.col("admission_priority") > 100, "MOMENTUM").otherwise("LAUNCH").alias("origin"),
        F.col("last_seen_at").alias("collected_at"), "liquidity_usd", "volume_h24_usd", F.col("first_added_at").alias("first_seen_at"),
    )
    return ca.seed_from_history(tokens, members, 400).select("token_id")


@query("t6_latest_state", oracle("SELECT token_id, arg_max(seq, (t, -seq)) AS seq FROM cand GROUP BY 1", "cand"))
def latest_state(spark, sf_dir):
    c = ca.normalize(candidates(spark, sf_dir)).select("token_id", "seq", F.col("detected_at").alias("observed_at"))
    return ca.latest_state(c).select("token_id", "seq")


@query("t11_last_trade_time", oracle("SELECT token_id, max(t) AS last_trade_us FROM snap WHERE price_usd IS NOT NULL GROUP BY 1", "snap"))
def last_trade_time(spark, sf_dir):
    s = ad.snapshots(spark, sf_dir).filter(F.col("price_usd").isNotNull())
    return s.groupBy("token_id").agg(micros(F.max("collected_at")).alias("last_trade_us"))


# ---- filter, preliminary score, evidence ---------------------------------------------------------

define("pre0", """SELECT *, CASE WHEN k % 2 = 0 THEN 'MOMENTUM' ELSE 'LAUNCH' END AS origin, CASE WHEN k % 10 <> 9 THEN CAST(k AS BIGINT) * 600000000 END AS age FROM si1""", "si1")
define("si1", "SELECT si0.*, ev.k FROM si0 JOIN ev ON ev.event_id = si0.snapshot_id", "si0", "ev")
define("pre", """SELECT *, CASE WHEN origin = 'LAUNCH' AND age > 21600000000 THEN 'too_old' WHEN liquidity_usd < 2000 THEN 'low_liquidity' END AS reason FROM pre0""", "pre0")
_L = lambda x, m: f"CASE WHEN {x} >= 4 THEN {m} WHEN {x} >= 3 THEN {m} * 0.85::DOUBLE WHEN {x} >= 2 THEN {m} * 0.65::DOUBLE WHEN {x} >= 1.5 THEN {m} * 0.45::DOUBLE WHEN {x} >= 1.1 THEN {m} * 0.25::DOUBLE ELSE 0 END"
_R = lambda n, d: f"CASE WHEN {n} IS NULL OR {d} IS NULL THEN NULL WHEN {d} > 0 THEN {n} / {d} WHEN {d} = 0 AND {n} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END"
define("prs", f"""SELECT *, CASE WHEN dep THEN greatest(0, tot - 10) ELSE tot END AS total FROM (SELECT *, reason IS NULL AND origin = 'LAUNCH' AND coalesce(market_cap_usd > 500000, false) AS dep,
  least(100, acc + pres + coalesce(CASE WHEN buys_m5 + sells_m5 >= 20 THEN 20 WHEN buys_m5 + sells_m5 >= 10 THEN 15 WHEN buys_m5 + sells_m5 >= 5 THEN 10 WHEN buys_m5 + sells_m5 > 0 THEN 5 ELSE 0 END, 0)
   + CASE WHEN dpt >= 0.2::DOUBLE THEN 15 WHEN dpt >= 0.1::DOUBLE THEN 12 WHEN dpt >= 0.05::DOUBLE THEN 9 WHEN dpt >= 0.02::DOUBLE THEN 6 WHEN dpt >= 0.01::DOUBLE THEN 3 ELSE 0 END
   + CASE WHEN age <= 1800000000 THEN 20 WHEN age <= 3600000000 THEN 15 WHEN age <= 7200000000 THEN 10 WHEN age <= 21600000000 THEN 5 ELSE 0 END) AS tot
  FROM (SELECT *, {_L(_R('volume_m5_usd', '(buy_volume_m5_usd / 12)'), 25)} AS acc, {_L(_R('buys_m5', 'sells_m5'), 20)} AS pres, {_R('liquidity_usd', 'market_cap_usd')} AS dpt FROM pre))""", "pre")


def prepared(spark, sf_dir):
    df = ad.score_inputs_from(ad._events(spark, sf_dir).withColumn("value", F.col("value")))
    ev = ad._events(spark, sf_dir).select(F.col("event_id").alias("snapshot_id"), "k")
    df = df.join(ev, "snapshot_id")
    origin = F.when(F.col("k") % 2 == 0, "MOMENTUM").otherwise("LAUNCH")
    age = F.when(F.col("k") % 10 != 9, F.col("k").cast("bigint") * 10 * MINUTE)
    df = df.withColumns({"origin": origin, "age": age})
    return df.withColumn("decision", ca.fast_filter(F.col("origin"), F.col("age"), F.col("liquidity_usd"), F.col("market_cap_usd")))


@query("p11_fast_filter", oracle("""SELECT snapshot_id, reason IS NULL AS accepted, reason AS reject_reason, CASE WHEN age IS NULL OR (origin = 'LAUNCH' AND age > 21600000000) THEN 'UNKNOWN' WHEN age <= 7200000000 THEN 'EARLY_POOL' ELSE 'EARLY_LATE' END AS age_band,
  reason IS NULL AND origin = 'LAUNCH' AND coalesce(market_cap_usd > 500000, false) AS deprioritized FROM pre""", "pre"))
def fast_filter(spark, sf_dir):
    return prepared(spark, sf_dir).select("snapshot_id", "decision.*")


def with_preliminary(spark, sf_dir):
    c = F.col
    df = prepared(spark, sf_dir)
    s = ca.preliminary_score(c("volume_m5_usd"), c("buy_volume_m5_usd"), c("buys_m5"), c("sells_m5"), c("liquidity_usd"), c("market_cap_usd"), c("age"), c("decision.deprioritized"))
    return df.withColumn("prelim", s)


@query("p13_preliminary_score", oracle("SELECT snapshot_id, round(acc, 6) AS volume_acceleration, round(pres, 6) AS buy_pressure, round(total, 6) AS total FROM prs", "prs"))
def preliminary_score(spark, sf_dir):
    r = lambda n: F.round(F.col("prelim")[n], 6).alias(n)
    return with_preliminary(spark, sf_dir).select("snapshot_id", r("volume_acceleration"), r("buy_pressure"), r("total"))


@query("p14_deep_eligible", oracle("SELECT total >= 40 AS deep_eligible, count(*) AS candidates FROM prs GROUP BY 1", "prs"))
def deep_eligible(spark, sf_dir):
    return with_preliminary(spark, sf_dir).groupBy(F.col("prelim.deep_eligible").alias("deep_eligible")).agg(F.count(F.lit(1)).alias("candidates"))


@query("o2_candidate_order", oracle("SELECT CAST(snapshot_id AS VARCHAR) AS token_id, round(total, 6) AS score, dep AS deprioritized FROM prs WHERE reason IS NULL ORDER BY total DESC, dep, 1", "prs"))
def candidate_order(spark, sf_dir):
    """Accepted candidates in publishing order: one range-partitioned sort, no single-task ranking."""
    df = with_preliminary(spark, sf_dir).filter(F.col("decision.accepted")).select(
        F.col("snapshot_id").cast("string").alias("token_id"), F.round("prelim.total", 6).alias("score"),
        F.col("decision.deprioritized").alias("deprioritized"),
    )
    return df.orderBy(*ca.candidate_order())


@query("p15_evidence_presence", oracle("""SELECT snapshot_id, CAST(price_usd IS NOT NULL AS INTEGER) + CAST(market_cap_usd IS NOT NULL AS INTEGER) + CAST(liquidity_usd IS NOT NULL AS INTEGER) + CAST(volume_m5_usd IS NOT NULL AS INTEGER) AS evidence_count,
  coalesce(price_usd, market_cap_usd, liquidity_usd, volume_m5_usd, buys_m5, sells_m5) IS NOT NULL AS has_evidence FROM si0""", "si0"))
def evidence_presence(spark, sf_dir):
    df = ad.score_inputs(spark, sf_dir)
    count = ca.evidence_count([F.col(f)["quality"] for f in ca.COUNT_FIELDS if f in df.columns])
    has = ca.any_evidence([F.col(f)["quality"] for f in ca.PRESENCE_FIELDS if f in df.columns])
    return df.select("snapshot_id", count.alias("evidence_count"), has.alias("has_evidence"))


@query("p16_quality_map", oracle("SELECT snapshot_id, price_usd_q AS price_usd, buyers_m5_q AS buyers_m5, 'missing' AS fdv_usd, 29 AS keys FROM si0", "si0"))
def quality_map(spark, sf_dir):
    df = ad.score_inputs(spark, sf_dir)
    m = ca.quality_map(df)
    return df.select("snapshot_id", m["price_usd"].alias("price_usd"), m["buyers_m5"].alias("buyers_m5"), m["fdv_usd"].alias("fdv_usd"), F.size(m).alias("keys"))


@query("p18_latest_evidence_time", oracle("SELECT snapshot_id, CASE WHEN price_usd_q <> 'missing' OR liquidity_usd_q <> 'missing' THEN t ELSE t - 3600000000 END AS latest_us FROM si0", "si0"))
def latest_evidence_time(spark, sf_dir):
    early = F.timestamp_micros(micros("collected_at") - HOUR)
    at = ca.latest_evidence_time(early, F.col("price_usd"), F.col("liquidity_usd"))
    return ad.score_inputs(spark, sf_dir).select("snapshot_id", micros(at).alias("latest_us"))


@query("p8_token_age", oracle("SELECT seq, greatest(0, 978307200000000 - t) // 1000000 AS age_seconds, 'EARLIEST_PAIR' AS provenance FROM cand", "cand"))
def token_age(spark, sf_dir):
    now = F.timestamp_micros(F.lit(978307200000000))
    c = candidates(spark, sf_dir)
    created = [F.col("discovery_pool_created_at"), F.col("chain_created_at"), F.col("trigger_pool_created_at")]
    return c.select(
        "seq", (ca.token_age(now, *created) / 1_000_000).cast("bigint").alias("age_seconds"),
        ca.age_provenance(F.lit(""), F.col("chain_created_at"), [created[0], created[2]]).alias("provenance"),
    )


@query("p12_launch_type", oracle("SELECT seq, CASE WHEN 915148800000000 - t > 7200000000 THEN 'REACTIVATION' ELSE 'NEW_LAUNCH' END AS launch_type FROM cand", "cand"))
def launch_type(spark, sf_dir):
    now = F.timestamp_micros(F.lit(915148800000000))
    none = F.lit(None).cast("timestamp")
    return candidates(spark, sf_dir).select("seq", ca.launch_type(now, none, F.col("detected_at"), none)["launch_type"].alias("launch_type"))


define("mm", """SELECT c.c_custkey AS token_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bp, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal * 3 END AS bl, o.found, o.dp, o.dl FROM customer c
  LEFT JOIN (SELECT o_custkey, true AS found, max(o_totalprice) FILTER (o_orderstatus <> 'P') AS dp, max(o_totalprice) FILTER (o_orderstatus = 'F') AS dl FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")


@query("c10_market_merge", oracle("""SELECT token_id, CASE WHEN found AND dp IS NOT NULL THEN dp ELSE bp END AS price, CASE WHEN found AND dl IS NOT NULL THEN 'pair' WHEN bl IS NOT NULL THEN 'pool' WHEN found IS NULL THEN 'pool' ELSE 'pool' END AS liquidity_source,
  CASE WHEN found IS NULL THEN 'gecko' WHEN bp IS NOT NULL OR bl IS NOT NULL THEN 'merged' ELSE 'dex' END AS market_data_source, CASE WHEN found THEN 'full' ELSE 'partial' END AS market_data_quality FROM mm""", "mm"))
def market_merge(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    base = c.select(
        F.col("c_custkey").alias("token_id"), q.fresh_or_missing(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), "pool").alias("price_usd"),
        q.fresh_or_missing(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") * 3), "pool").alias("liquidity_usd"),
    )
    o = ad.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("token_id")).agg(
        F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("dp"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("dl"),
    )
    pair = o.select("token_id", q.fresh_or_missing(F.col("dp"), "pair").alias("price_usd"), q.fresh_or_missing(F.col("dl"), "pair").alias("liquidity_usd"))
    m = ca.merge_market(base, pair, ["price_usd", "liquidity_usd"])
    return m.select("token_id", F.col("price_usd.value").alias("price"), F.col("liquidity_usd.source").alias("liquidity_source"), "market_data_source", "market_data_quality")


@query("c12_momentum_evidence", oracle("""SELECT snapshot_id, price_usd_q <> 'missing' OR liquidity_usd_q <> 'missing' AS price_available, CASE WHEN price_usd_q <> 'missing' THEN 'h1' ELSE 'm5' END AS price_window,
  round(CASE WHEN sells_m5 > 0 THEN buys_m5 / sells_m5 END, 8) AS buy_pressure, liquidity_usd_q <> 'missing' AS liquidity_available FROM si0""", "si0"))
def momentum_evidence(spark, sf_dir):
    df = ad.score_inputs(spark, sf_dir)
    absent = q.fresh_or_missing(F.lit(None).cast("double"))
    df = df.withColumns({
        "price_change_h1": F.col("price_usd"), "price_change_m5": F.col("liquidity_usd"), "volume_h1_usd": F.col("volume_m5_usd"), "volume_24h_usd": absent,
        "buys_h1": absent, "sells_h1": absent, "aggregate_buyers_h1": absent, "aggregate_buyers_m5": F.col("buyers_m5"),
    })
    m = ca.momentum_evidence(df)
    return df.select(
        "snapshot_id", m["price_momentum"]["available"].alias("price_available"), m["price_momentum"]["window"].alias("price_window"),
        F.round(m["buy_pressure"]["value"], 8).alias("buy_pressure"), m["liquidity"]["available"].alias("liquidity_available"),
    )


@query("p4_filter_ratio", oracle("SELECT event_id, CASE WHEN r IS NULL THEN NULL WHEN isinf(r) THEN -1 ELSE round(r, 8) END AS ratio FROM (SELECT event_id, CASE WHEN d > 0 THEN n / CAST(d AS DOUBLE) WHEN d = 0 AND n > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END AS r FROM (SELECT event_id, k % 11 AS n, k % 7 - 1 AS d FROM ev))", "ev"))
def filter_ratio(spark, sf_dir):
    r = q.open_ratio(F.col("k") % 11, F.col("k") % 7 - 1)
    return ad._events(spark, sf_dir).select("event_id", F.when(r == float("inf"), -1.0).otherwise(F.round(r, 8)).alias("ratio"))


@query("p10_age_provenance", oracle("SELECT seq, CASE WHEN seq % 5 = 0 THEN 'ON_CHAIN_CREATION' WHEN pool <> '' THEN 'EARLIEST_PAIR' ELSE 'LOCAL_FIRST_SEEN_LOWER_BOUND' END AS provenance FROM cand", "cand"))
def age_provenance(spark, sf_dir):
    at = F.col("detected_at")
    chain = F.when(F.col("seq") % 5 == 0, at)
    pair = F.when(F.col("pair_address") != "", at)
    return candidates(spark, sf_dir).select("seq", ca.age_provenance(F.lit(None).cast("string"), chain, [pair]).alias("provenance"))
