"""Queries on trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import DAY
from tidemark.operators import trades as tr
from tidemark.sources import adapters as ad

WIDTH = 3 * DAY
define("tw", """SELECT t.*, CASE WHEN a.at - t.t BETWEEN 0 AND 259200000000 THEN 'current'
   WHEN a.at - t.t > 259200000000 AND a.at - t.t <= 518400000000 THEN 'previous' END AS w
   FROM trades t JOIN (SELECT pool, max(t) AS at FROM trades WHERE side IS NOT NULL GROUP BY 1) a USING (pool)
   WHERE side IS NOT NULL""", "trades")
define("peraddr", """SELECT pool, w, address, count(*) FILTER (side = 'buy') AS b, count(*) FILTER (side = 'sell') AS s,
   coalesce(sum(usd) FILTER (side = 'buy'), 0) AS bv, coalesce(sum(usd) FILTER (side = 'sell'), 0) AS sv
   FROM tw WHERE w IS NOT NULL GROUP BY 1, 2, 3""", "tw")
define("tstats", """SELECT pool, w, CAST(sum(b) AS BIGINT) AS buys, CAST(sum(s) AS BIGINT) AS sells,
   count(*) FILTER (b > 0) AS ub, count(*) FILTER (s > 0) AS us, sum(bv) AS bv, sum(sv) AS sv,
   CASE WHEN sum(bv + sv) > 0 THEN max(bv + sv) / sum(bv + sv) ELSE 0 END AS top_share FROM peraddr GROUP BY 1, 2""", "peraddr")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = tr.valid_trades(ad.trades(spark, sf_dir))
    anchors = good.groupBy("pool").agg(F.max("traded_at").alias("observed_at"))
    return tr.label_windows(good.join(anchors, "pool"), "observed_at", WIDTH)


@query("a1_trade_window_stats", oracle("""SELECT pool, w AS trade_window, buys, sells, ub AS unique_buyers, us AS unique_sellers,
  round(bv, 4) AS buy_volume_usd, round(sv, 4) AS sell_volume_usd FROM tstats""", "tstats"))
def trade_window_stats(spark, sf_dir):
    stats = tr.window_stats(labelled(spark, sf_dir), ["pool"])
    return stats.select(
        "pool", "trade_window", "buys", "sells", "unique_buyers", "unique_sellers",
        F.round("buy_volume_usd", 4).alias("buy_volume_usd"), F.round("sell_volume_usd", 4).alias("sell_volume_usd"),
    )


@query("a2_top_address_share", oracle("""SELECT pool, w AS trade_window, round(top_share, 8) AS top_share,
  top_share > 0.5 AS concentrated FROM tstats""", "tstats"))
def top_address_share(spark, sf_dir):
    stats = tr.window_stats(labelled(spark, sf_dir), ["pool"])
    return stats.select(
        "pool", "trade_window", F.round("top_share", 8).alias("top_share"),
        (F.col("top_share") > tr.CONCENTRATION_LIMIT).alias("concentrated"),
    )


@query("c9_trade_evidence", oracle("""SELECT c.pool, c.ub AS buyers, c.us AS sellers,
  round(CASE WHEN coalesce(p.ub, 0) > 0 THEN c.ub / CAST(p.ub AS DOUBLE) ELSE 999 END, 8) AS buyer_velocity,
  round(CASE WHEN coalesce(p.bv + p.sv, 0) > 0 THEN (c.bv + c.sv) / (p.bv + p.sv) ELSE 999 END, 8) AS volume_velocity,
  'fresh' AS quality, c.top_share > 0.5 AS concentrated
  FROM (SELECT * FROM tstats WHERE w = 'current') c LEFT JOIN (SELECT * FROM tstats WHERE w = 'previous') p USING (pool)""", "tstats"))
def trade_evidence(spark, sf_dir):
    both = tr.windows_side_by_side(tr.window_stats(labelled(spark, sf_dir), ["pool"]), ["pool"])
    ev = tr.trade_evidence(both.withColumn("observed_at", F.lit(None).cast("timestamp")), "observed_at")
    finite = lambda c: F.round(F.when(F.col(c)["value"] == float("inf"), F.lit(999.0)).otherwise(F.col(c)["value"]), 8)
    return ev.select(
        "pool", F.col("buyers_m5.value").cast("bigint").alias("buyers"), F.col("sellers_m5.value").cast("bigint").alias("sellers"),
        finite("buyer_velocity").alias("buyer_velocity"), finite("volume_velocity").alias("volume_velocity"),
        F.col("buyer_velocity.quality").alias("quality"), (F.col("concentrated_activity.value") == 1).alias("concentrated"),
    )
