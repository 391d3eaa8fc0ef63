"""Queries that run a stream over the event table to completion and read its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.catalog.study import HZ
from tidemark.functions.timecol import HOUR, micros
from tidemark.operators import history as hi, study as st
from tidemark.session import shared_dir, use_utc
from tidemark.sources import adapters as ad
from tidemark.streaming import jobs


def events(spark, sf_dir):
    return ad.adapt_events(jobs.file_stream(use_utc(spark), sf_dir, "events.parquet"))


define("sw", """SELECT pool, t // 21600000000 * 21600000000 AS ws, address, count(*) FILTER (side = 'buy') AS b, count(*) FILTER (side = 'sell') AS s, coalesce(sum(usd) FILTER (side = 'buy'), 0) AS bv, coalesce(sum(usd) FILTER (side = 'sell'), 0) AS sv
  FROM trades WHERE side IS NOT NULL GROUP BY 1, 2, 3""", "trades")
define("sws", """SELECT pool, ws, CAST(sum(b) AS BIGINT) AS buys, CAST(sum(s) AS BIGINT) AS sells, count(*) FILTER (b > 0) AS unique_buyers, sum(bv) + sum(sv) AS vol FROM sw GROUP BY 1, 2
  HAVING ws + 21600000000 <= (SELECT max(t) // 1000 * 1000 FROM trades WHERE side IS NOT NULL)""", "sw", "trades")


def windows(spark, sf_dir, width, slide=None):
    good = ad.trades_from(events(spark, sf_dir)).filter(F.col("side").isNotNull())
    root = shared_dir(spark, "trade-windows")
    table = jobs.TradeWindows(spark, root, width, slide, pool_type=dict(good.dtypes)["pool"])
    table.consume(good, f"{root}/checkpoint")
    return table.closed()


@query("t5_tumbling_windows", oracle("SELECT pool, ws AS window_us, buys, sells, unique_buyers FROM sws", "sws"))
def tumbling_windows(spark, sf_dir):
    return windows(spark, sf_dir, "6 hours").select("pool", micros("window_start").alias("window_us"), "buys", "sells", "unique_buyers")


@query("t5_previous_window", oracle("SELECT a.pool, a.ws AS window_us, b.unique_buyers AS previous_unique_buyers, round(b.vol, 4) AS previous_volume_usd FROM sws a LEFT JOIN sws b ON a.pool = b.pool AND b.ws + 21600000000 = a.ws", "sws"))
def previous_window(spark, sf_dir):
    return jobs.with_previous_window(windows(spark, sf_dir, "6 hours")).select(
        "pool", micros("window_start").alias("window_us"), "previous_unique_buyers", F.round("previous_volume_usd", 4).alias("previous_volume_usd")
    )


@query("t1_t3_signal_stream", oracle("SELECT token_id, score_version, CAST(threshold AS BIGINT) AS threshold, sid AS signal_snapshot_id FROM sig", "sig"))
def signal_stream(spark, sf_dir):
    root = shared_dir(use_utc(spark), "signals")
    scores = ad.scores_from(ad.snapshots_from(events(spark, sf_dir)))
    table = jobs.signal_table(spark, f"{root}/table")
    jobs.signal_stream(scores, table, f"{root}/checkpoint", 0)
    return table.read().select("token_id", "score_version", "threshold", "signal_snapshot_id")


@query("t2_t4_outcome_stream", oracle("""SELECT token_id, score_version, CAST(threshold AS BIGINT) AS threshold, horizon, status, xid AS selected_snapshot_id, round(ret, 8) AS return_decimal FROM outc
  WHERE status IN ('MATURED', 'INSUFFICIENT_DATA')""", "outc"))
def outcome_stream(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    entries = st.paper_entries(st.first_crossings(ad.scores_from(snaps), 0))
    pending = st.expand_horizons(entries, HZ).filter(F.col("status") == "PENDING")
    root = shared_dir(spark, "outcomes")
    pending.write.parquet(f"{root}/pending")
    stored = lambda: spark.read.parquet(f"{root}/pending")
    outcomes = jobs.Outcomes(spark, root)
    outcomes.consume(ad.snapshots_from(events(spark, sf_dir)), stored, f"{root}/checkpoint", max(h.tolerance for h in HZ))
    done = outcomes.settled(stored()).filter(F.col("status") != "PENDING")
    return done.withColumn("return_decimal", F.round("return_decimal", 8) + 0.0)


@query("t6_latest_state_stream", oracle("SELECT CAST(user_id AS VARCHAR) AS token_id, arg_max(event_id, (t, -event_id)) AS seq FROM ev GROUP BY 1", "ev"))
def latest_state_stream(spark, sf_dir):
    root = shared_dir(use_utc(spark), "state")
    obs = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("token_id"), F.col("event_id").alias("seq"), F.col("ts").alias("observed_at"))
    table = jobs.state_table(spark, f"{root}/table", "token_id string, seq long, observed_at timestamp")
    jobs.latest_state_stream(obs, table, f"{root}/checkpoint")
    return table.read().select("token_id", "seq")


@query("t9_episode_stream", oracle("""SELECT instrument_id, s AS first_seq, l AS last_seq, n AS appearances, ep < last_ep AS closed FROM (SELECT instrument_id, ep, min(seq) AS s, max(seq) AS l, count(*) AS n,
  max(ep) OVER (PARTITION BY instrument_id) AS last_ep FROM (SELECT *, sum(isnew) OVER (PARTITION BY instrument_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ep FROM
  (SELECT m.instrument_id, e.seq, CASE WHEN coalesce(e.seq - lag(e.seq) OVER (PARTITION BY instrument_id ORDER BY e.seq) > 3, true) THEN 1 ELSE 0 END AS isnew FROM members m JOIN eff e USING (run_id))) GROUP BY 1, 2)""", "eff", "members"))
def episode_stream(spark, sf_dir):
    runs = hi.effective_runs(ad.opportunity_runs(spark, sf_dir), None, HOUR)
    seen = ad.run_members(spark, sf_dir).join(runs.select("asset_class", "run_id", "seq"), "run_id")
    root = shared_dir(spark, "presences")
    seen.select("asset_class", "instrument_id", "seq").write.parquet(root)
    where = shared_dir(spark, "episodes")
    table = jobs.episode_table(spark, f"{where}/table")
    jobs.presence_stream(jobs.file_stream(spark, root, files_per_batch=2), table, f"{where}/checkpoint")
    return jobs.read_episodes(table).select("instrument_id", "first_seq", "last_seq", "appearances", "closed")


@query("t5_sliding_windows", oracle("""SELECT pool, ws AS window_us, CAST(sum(b) AS BIGINT) AS buys, count(*) FILTER (b > 0) AS unique_buyers FROM (SELECT pool, (t // 21600000000 - o) * 21600000000 AS ws, address, count(*) FILTER (side = 'buy') AS b
  FROM trades CROSS JOIN (VALUES (0), (1)) v(o) WHERE side IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING ws + 43200000000 <= (SELECT max(t) // 1000 * 1000 FROM trades WHERE side IS NOT NULL)""", "trades"))
def sliding_windows(spark, sf_dir):
    return windows(spark, sf_dir, "12 hours", "6 hours").select("pool", micros("window_start").alias("window_us"), "buys", "unique_buyers")
