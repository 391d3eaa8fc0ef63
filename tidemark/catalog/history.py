"""Queries on runs, episodes, universes and watchlists."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import DAY, HOUR, MINUTE, micros
from tidemark.operators import history as hi, universe as un
from tidemark.plans.market_scan import latest_derivatives
from tidemark.sources import adapters as ad

BUCKET = HOUR
LISTS = {"crypto": ["I0", "I1", "I2", "I3", "I4", "I5"], "stock": ["I14", "I15", "I16"]}

define("now", "SELECT max(finished_t) AS t1, max(finished_t) - 604800000000 AS t0 FROM runs", "runs")
define("eff", """SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY finished_t, run_id) AS seq FROM
  (SELECT * FROM runs WHERE status IN ('completed','degraded') QUALIFY row_number() OVER (PARTITION BY asset_class, finished_t // 3600000000 ORDER BY finished_t DESC, run_id DESC) = 1)""", "runs")
define("epi", """SELECT instrument_id, ep, min(seq) AS s, max(seq) AS l, min(finished_t) AS started, max(finished_t) AS last_listed, arg_min(price, seq) AS first_price,
    count(*) FILTER (finished_t >= (SELECT t0 FROM now)) AS appearances FROM (SELECT *, sum(isnew) OVER (PARTITION BY instrument_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ep FROM
    (SELECT m.instrument_id, m.price, e.seq, e.finished_t, CASE WHEN coalesce(e.seq - lag(e.seq) OVER (PARTITION BY instrument_id ORDER BY e.seq) > 3, true) THEN 1 ELSE 0 END AS isnew
     FROM members m JOIN eff e USING (run_id))) GROUP BY 1, 2""", "eff", "members", "now")
define("epi2", """SELECT *, CASE WHEN ended IS NULL THEN 'active' ELSE 'ended' END AS status, greatest(0, coalesce(CASE WHEN ended IS NULL THEN ms ELSE l + 3 END - greatest(s, w0) + 1, 0)) AS experienced
  FROM (SELECT p.*, e.finished_t AS ended, (SELECT max(seq) FROM eff) AS ms, (SELECT min(seq) FROM eff WHERE finished_t >= (SELECT t0 FROM now)) AS w0
    FROM epi p LEFT JOIN eff e ON e.seq = p.l + 3) WHERE ended IS NULL OR ended >= (SELECT t0 FROM now)""", "epi", "eff", "now")
define("epr", """SELECT *, CASE WHEN first_price > 0 THEN (eval_price - first_price) / first_price * 100 END AS ret, CASE WHEN experienced > 0 THEN appearances / experienced * 100 ELSE 0 END AS rate
  FROM (SELECT e.* EXCLUDE (ref_t), d.price_usd AS eval_price FROM (SELECT *, coalesce(ended, (SELECT t1 FROM now)) AS ref_t FROM epi2) e
    ASOF LEFT JOIN (SELECT * FROM deriv WHERE asset_class = 'crypto') d ON d.instrument_id = e.instrument_id AND e.ref_t >= d.t)""", "epi2", "deriv", "now")
define("board", "SELECT * FROM epr QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ep DESC) = 1", "epr")


def window_of(runs):
    last = runs.agg(F.max("finished_at").alias("t")).select("t").scalar()
    return F.timestamp_micros(micros(last) - 7 * DAY), last


def found(spark, sf_dir):
    runs = ad.opportunity_runs(spark, sf_dir)
    start, end = window_of(runs)
    return hi.episodes(runs, ad.run_members(spark, sf_dir), start, end, BUCKET)


def evaluated(spark, sf_dir):
    _, end = window_of(ad.opportunity_runs(spark, sf_dir))
    return hi.with_returns(found(spark, sf_dir), ad.derivatives(spark, sf_dir), end)


@query("w19_effective_runs", oracle("SELECT run_id, finished_t AS finished_us, seq FROM eff", "eff"))
def effective_runs(spark, sf_dir):
    return hi.effective_runs(ad.opportunity_runs(spark, sf_dir), None, BUCKET).select("run_id", micros("finished_at").alias("finished_us"), "seq")


@query("w22_episodes", oracle("""SELECT instrument_id, CAST(ep AS BIGINT) AS episode, started AS started_us, ended AS ended_us, status, appearances, CAST(experienced AS BIGINT) AS experienced_scans FROM epi2""", "epi2"))
def episodes(spark, sf_dir):
    return found(spark, sf_dir).select(
        "instrument_id", "episode", micros("started_at").alias("started_us"), micros("ended_at").alias("ended_us"), "status",
        "appearances", "experienced_scans",
    )


@query("p32_episode_returns", oracle("SELECT instrument_id, CAST(ep AS BIGINT) AS episode, round(eval_price, 4) AS evaluation_price, round(ret, 6) AS return_pct FROM epr", "epr"))
def episode_returns(spark, sf_dir):
    return evaluated(spark, sf_dir).select(
        "instrument_id", "episode", F.round("evaluation_price", 4).alias("evaluation_price"), (F.round("return_pct", 6) + 0.0).alias("return_pct")
    )


def _board(order):
    return oracle(f"SELECT instrument_id, row_number() OVER (ORDER BY {order}) AS rank, status, appearances, round(rate, 6) AS listing_rate FROM board", "board")


def _ranked(spark, sf_dir, sort, direction):
    rows = hi.leaderboard(hi.latest_episode(evaluated(spark, sf_dir)), sort, direction)
    return rows.select("instrument_id", "rank", "status", "appearances", F.round("listing_rate", 6).alias("listing_rate"))


@query("o6_leaderboard_by_rate", _board("rate DESC, appearances DESC, instrument_id"))
def leaderboard_by_rate(spark, sf_dir):
    return _ranked(spark, sf_dir, "rate", "desc")


@query("o6_leaderboard_by_count", _board("appearances DESC, instrument_id"))
def leaderboard_by_count(spark, sf_dir):
    return _ranked(spark, sf_dir, "count", "desc")


@query("o6_leaderboard_by_return", _board("ret ASC NULLS LAST, appearances DESC, instrument_id"))
def leaderboard_by_return(spark, sf_dir):
    return _ranked(spark, sf_dir, "return", "asc")


@query("a14_window_summary", oracle("SELECT asset_class, count(*) AS effective_scans, max(finished_t) AS generated_us FROM eff WHERE finished_t >= (SELECT t0 FROM now) GROUP BY 1", "eff", "now"))
def window_summary(spark, sf_dir):
    runs = ad.opportunity_runs(spark, sf_dir)
    start, end = window_of(runs)
    return hi.window_summary(runs, start, end, BUCKET).select("asset_class", "effective_scans", micros("generated_at").alias("generated_us"))


@query("o8_latest_run", oracle("SELECT asset_class, run_id, status FROM runs WHERE status IN ('completed','degraded') QUALIFY row_number() OVER (PARTITION BY asset_class ORDER BY finished_t DESC, run_id DESC) = 1", "runs"))
def latest_run(spark, sf_dir):
    return hi.latest_published(ad.opportunity_runs(spark, sf_dir)).select("asset_class", "run_id", "status")


@query("p29_market_health", oracle("""SELECT r.run_id, (SELECT t1 FROM now) - r.finished_t <= 3600000000 AS ready FROM runs r WHERE status IN ('completed','degraded')""", "runs", "now"))
def market_health(spark, sf_dir):
    runs = ad.opportunity_runs(spark, sf_dir)
    _, end = window_of(runs)
    return hi.market_health(runs.filter(F.col("status").isin(*hi.PUBLISHED)), end, HOUR).select("run_id", "ready")


# ---- universe -----------------------------------------------------------------------------------

define("listed", """SELECT 'S' || s_suppkey || CASE WHEN s_suppkey % 11 = 3 THEN '-USD-SWAP' ELSE '-USDT-SWAP' END AS instrument_id, 'S' || s_suppkey AS symbol,
  CASE WHEN s_nationkey % 3 = 0 THEN 'stock' ELSE 'crypto' END AS asset_class, s_acctbal AS price_usd, round(tv, 2) AS turnover, CASE WHEN s_suppkey % 9 <> 4 THEN qty * 1000 END AS oi,
  CASE WHEN s_suppkey % 4 <> 1 THEN 0.0001 END AS funding, 946684800000000 + s_suppkey * 86400000000 AS listed_t, CASE WHEN s_suppkey % 13 <> 7 THEN 0.01 END AS tick
  FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS tv, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
define("gated", """SELECT *, (978307200000000 - listed_t) / 3600000000 AS age_hours FROM listed WHERE instrument_id LIKE '%-USDT-SWAP' AND asset_class = 'crypto' AND price_usd > 0 AND tick > 0
  AND 978307200000000 - listed_t >= 300 * 86400000000 AND turnover >= 1000000 AND oi >= 100000""", "listed")
define("liq", """SELECT *, pt * 0.5::DOUBLE + po * 0.35::DOUBLE + pa * 0.1::DOUBLE + CASE WHEN funding IS NULL THEN 0 ELSE 5 END AS score FROM (SELECT *,
  CASE WHEN n <= 1 THEN 100 ELSE 100 * percent_rank() OVER (ORDER BY turnover) END AS pt, CASE WHEN n <= 1 THEN 100 ELSE 100 * percent_rank() OVER (ORDER BY oi) END AS po,
  CASE WHEN n <= 1 THEN 100 ELSE 100 * percent_rank() OVER (ORDER BY age_hours) END AS pa FROM (SELECT *, count(*) OVER () AS n FROM gated))""", "gated")


def gated(spark, sf_dir):
    now = F.timestamp_micros(F.lit(978307200000000))
    rows = ad.listed_suppliers(spark, sf_dir)
    again = rows.filter(F.crc32("instrument_id") % 3 == 0).withColumn("turnover_24h_usd", F.col("turnover_24h_usd") * 2)  # later listings of the same instrument
    return un.gate(rows.unionByName(again), now, "crypto", 300 * DAY, 1e6, 1e5)


@query("w20_pool_percentiles", oracle("SELECT instrument_id, round(pt, 6) AS p_turnover, round(po, 6) AS p_open_interest, round(pa, 6) AS p_age FROM liq", "liq"))
def pool_percentiles(spark, sf_dir):
    return un.liquidity_scores(gated(spark, sf_dir)).select("instrument_id", *[F.round(c, 6).alias(c) for c in ("p_turnover", "p_open_interest", "p_age")])


@query("c21_liquid_universe", oracle("SELECT instrument_id, round(score, 6) AS liquidity_score FROM liq ORDER BY score DESC, turnover DESC, instrument_id LIMIT 25", "liq"))
def liquid_universe(spark, sf_dir):
    return un.build_universe(gated(spark, sf_dir), 25).select("instrument_id", F.round("liquidity_score", 6).alias("liquidity_score"))


@query("o4_universe_order", oracle("SELECT instrument_id, row_number() OVER (ORDER BY score DESC, turnover DESC, instrument_id) AS position FROM liq ORDER BY 2 LIMIT 60", "liq"))
def universe_order(spark, sf_dir):
    order = Window.partitionBy("asset_class").orderBy(F.col("liquidity_score").desc(), F.col("turnover_24h_usd").desc(), "instrument_id")
    return un.build_universe(gated(spark, sf_dir)).select("instrument_id", F.row_number().over(order).cast("bigint").alias("position"))


@query("c22_universe_refresh", oracle("SELECT instrument_id, price_usd FROM listed WHERE price_usd > 2000 AND instrument_id IN (SELECT instrument_id FROM liq ORDER BY score DESC, turnover DESC, instrument_id LIMIT 25)", "listed", "liq"))
def universe_refresh(spark, sf_dir):
    batch = ad.listed_suppliers(spark, sf_dir).filter(F.col("price_usd") > 2000)
    return un.refresh_universe(un.build_universe(gated(spark, sf_dir), 25), batch).select("instrument_id", "price_usd")


@query("u5_members_still_quoted", oracle("SELECT instrument_id FROM gated INTERSECT SELECT instrument_id FROM listed WHERE price_usd > 2000", "gated", "listed"))
def members_still_quoted(spark, sf_dir):
    quoted = ad.listed_suppliers(spark, sf_dir).filter(F.col("price_usd") > 2000)
    return gated(spark, sf_dir).select("instrument_id").join(quoted, "instrument_id", "left_semi")


# ---- watchlist ----------------------------------------------------------------------------------

define("dprev", """SELECT *, CASE WHEN near AND price_usd > 0 AND p_price > 0 THEN (price_usd / p_price - 1) * 100 END AS price_change,
  CASE WHEN near AND open_interest_usd IS NOT NULL AND p_oi > 0 THEN (open_interest_usd / p_oi - 1) * 100 END AS oi_change FROM (SELECT *, t > p_t AND t - p_t <= 10800000000 AS near FROM
  (SELECT *, lag(t) OVER w AS p_t, lag(price_usd) OVER w AS p_price, lag(open_interest_usd) OVER w AS p_oi FROM deriv WINDOW w AS (PARTITION BY instrument_id ORDER BY t, id)))""", "deriv")
SIGNAL = """concat_ws(' / ', CASE WHEN change_24h_pct >= 3 THEN 'STRONG' WHEN change_24h_pct >= 1 THEN 'FIRM' WHEN change_24h_pct <= -3 THEN 'WEAK' WHEN change_24h_pct <= -1 THEN 'SOFT' ELSE 'SIDEWAYS' END,
  CASE WHEN oi_change >= 5 THEN 'ADDING' WHEN oi_change <= -5 THEN 'REDUCING' END, CASE WHEN funding_rate >= 0.0005 THEN 'LONGS_CROWDED' WHEN funding_rate <= -0.0005 THEN 'SHORTS_CROWDED' END)"""
define("watch", f"""SELECT *, {SIGNAL} AS signal FROM (SELECT * FROM dprev QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY t DESC, id DESC) = 1)
  WHERE symbol IN ('I0','I1','I2','I3','I4','I5','I14','I15','I16')""", "dprev")


def observed(spark, sf_dir):
    return un.with_previous_observation(ad.derivatives(spark, sf_dir), 3 * HOUR)


def watched(spark, sf_dir):
    return un.watchlist(latest_derivatives(observed(spark, sf_dir)), LISTS)


@query("j17_previous_observation", oracle("SELECT id, round(price_change, 6) AS price_change_pct, round(oi_change, 6) AS open_interest_change_pct FROM dprev", "dprev"))
def previous_observation(spark, sf_dir):
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return observed(spark, sf_dir).select("id", r("price_change_pct"), r("open_interest_change_pct"))


@query("p20_market_signal", oracle(f"SELECT {SIGNAL} AS signal, count(*) AS observations FROM dprev GROUP BY 1", "dprev"))
def market_signal(spark, sf_dir):
    s = un.market_signal(F.col("change_24h_pct"), F.col("open_interest_change_pct"), F.col("funding_rate"))
    return observed(spark, sf_dir).groupBy(s.alias("signal")).agg(F.count(F.lit(1)).alias("observations"))


@query("p21_position_quadrant", oracle("""SELECT CASE WHEN price_change IS NULL OR oi_change IS NULL THEN 'WAITING' WHEN abs(price_change) < 0.05 OR abs(oi_change) < 0.05 THEN 'UNCLEAR'
  WHEN price_change > 0 AND oi_change > 0 THEN 'LONG_ENTRY' WHEN oi_change > 0 THEN 'SHORT_ENTRY' WHEN price_change > 0 THEN 'SHORT_COVER' ELSE 'LONG_EXIT' END AS quadrant, count(*) AS observations FROM dprev GROUP BY 1""", "dprev"))
def position_quadrant(spark, sf_dir):
    s = un.position_quadrant(F.col("price_change_pct"), F.col("open_interest_change_pct"))
    return observed(spark, sf_dir).groupBy(s.alias("quadrant")).agg(F.count(F.lit(1)).alias("observations"))


@query("c26_watchlist_report", oracle("SELECT asset_class, symbol, signal, row_number() OVER (PARTITION BY asset_class ORDER BY change_24h_pct DESC, symbol) AS position FROM watch", "watch"))
def watchlist_report(spark, sf_dir):
    return watched(spark, sf_dir).select("asset_class", "symbol", "signal", "position")


@query("o5_watchlist_order", oracle("SELECT asset_class, symbol, round(change_24h_pct, 6) AS change_24h_pct, row_number() OVER (PARTITION BY asset_class ORDER BY change_24h_pct DESC, symbol) AS position FROM watch", "watch"))
def watchlist_order(spark, sf_dir):
    return watched(spark, sf_dir).select("asset_class", "symbol", F.round("change_24h_pct", 6).alias("change_24h_pct"), "position")


@query("a13_watchlist_summary", oracle("""SELECT asset_class, count(*) FILTER (change_24h_pct > 0) AS rising, count(*) AS total, arg_min(symbol, (-change_24h_pct, symbol)) AS strongest,
  max(change_24h_pct) AS strongest_change, arg_max(symbol, (-change_24h_pct, symbol)) AS weakest, min(change_24h_pct) AS weakest_change FROM watch GROUP BY 1""", "watch"))
def watchlist_summary(spark, sf_dir):
    return un.watchlist_summary(watched(spark, sf_dir))


@query("w18_latest_two", oracle("SELECT instrument_id, rn AS observation_rank, id FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY t DESC, id DESC) AS rn FROM deriv WHERE asset_class = 'crypto') WHERE rn <= 2", "deriv"))
def latest_two(spark, sf_dir):
    """Newest two observations per instrument; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("instrument_id").orderBy(F.col("collected_at").desc(), F.col("id").desc())
    d = ad.derivatives(spark, sf_dir).filter(F.col("asset_class") == "crypto")
    ranked = d.withColumn("observation_rank", F.row_number().over(order)).filter(F.col("observation_rank") <= 2)
    return ranked.select("instrument_id", F.col("observation_rank").cast("bigint").alias("observation_rank"), "id")
