"""Queries on landed payloads; the documents are rendered by Spark from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import HOUR, MINUTE, micros
from tidemark.operators import trades as tr
from tidemark.sources import adapters as ad, payloads as pl


def iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pool_documents(spark, sf_dir):
    """One document of two pools per order; every seventeenth holds a bad number."""
    o = ad.table(spark, sf_dir, "orders")
    k, cust, at = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    chain = F.when(cust % 2 == 0, "bsc").otherwise("solana")
    price = F.when(k % 17 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice"))
    nothing = F.lit(None).cast("string")

    def pool(ref, created, price, cap):
        return F.struct(
            F.struct(
                F.concat(F.lit("Pool"), k).alias("address"), iso(created).alias("pool_created_at"), price.alias("base_token_price_usd"),
                cap.alias("market_cap_usd"), F.struct(F.struct((k % 9).alias("buys"), (k % 4).alias("sells")).alias("m5")).alias("transactions"),
                F.struct(F.when(k % 3 == 0, "12.5").alias("h1")).alias("volume_usd"),
            ).alias("attributes"),
            F.struct(F.struct(F.struct(ref.alias("id")).alias("data")).alias("base_token")).alias("relationships"),
        )

    ref_a, ref_b = F.concat(chain, F.lit("_Acc"), cust), F.concat(chain, F.lit("_Tok"), k % 50)
    cap = F.when(k % 7 != 0, F.lit("1000.5"))
    data = F.array(pool(ref_a, at, price, cap), pool(ref_b, F.timestamp_micros(micros(at) - (k % 12) * HOUR), F.lit("2.5"), nothing))
    included = F.array(F.struct(
        F.when(k % 4 == 0, "other").otherwise(ref_a).alias("id"),
        F.struct(F.concat(F.lit("MAIN"), cust).alias("address"), F.lit("Näme").alias("name"), F.lit("SYM").alias("symbol")).alias("attributes"),
    ))
    return o.select(
        F.to_json(F.struct(data.alias("data"), included.alias("included"))).alias("payload"), F.floor(k / 100).alias("run_id"), chain.alias("chain"),
        k.alias("page"), F.when(k % 2 == 0, "GECKO_TRENDING").otherwise("GECKO_TOP_VOLUME").alias("source"), F.timestamp_micros(micros(at) + HOUR).alias("collected_at"),
    )


define("pools", """SELECT o_orderkey AS k, o_orderkey // 100 AS run_id, CASE o_custkey % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS chain, x.pos, CASE WHEN o_orderkey % 2 = 0 THEN 'GECKO_TRENDING' ELSE 'GECKO_TOP_VOLUME' END AS source,
  CASE WHEN x.pos = 0 THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'MAIN' || o_custkey ELSE 'Acc' || o_custkey END ELSE 'Tok' || (o_orderkey % 50) END AS addr0,
  CASE WHEN x.pos = 0 THEN o_totalprice ELSE 2.5 END AS price, CASE WHEN x.pos = 0 THEN 0 ELSE o_orderkey % 12 END AS back, o_orderkey % 17 = 0 AS bad,
  CASE WHEN x.pos = 0 AND o_orderkey % 7 <> 0 THEN 'fresh' ELSE 'missing' END AS cap_quality FROM orders CROSS JOIN (VALUES (0), (1)) x(pos)""")
define("pools2", "SELECT *, chain || ':' || CASE chain WHEN 'bsc' THEN lower(addr0) ELSE addr0 END AS token_id FROM pools", "pools")


define("firsts", "SELECT *, bad AND pos = 0 AS wrong FROM pools2 WHERE back + 1 <= 6 QUALIFY row_number() OVER (PARTITION BY run_id, token_id ORDER BY k, pos) = 1", "pools2")
define("newp", "SELECT * FROM firsts WHERE k NOT IN (SELECT k FROM firsts WHERE wrong)", "firsts")


@query("s1_new_pools", oracle("SELECT run_id, token_id, k AS page, CAST(pos AS BIGINT) AS pos, round(price, 4) AS price_usd, cap_quality FROM newp", "newp"))
def new_pools(spark, sf_dir):
    rows, _ = pl.new_pools(pool_documents(spark, sf_dir))
    return rows.select("run_id", "token_id", "page", F.col("pos").cast("bigint").alias("pos"), F.round("price_usd.value", 4).alias("price_usd"), F.col("market_cap_usd.quality").alias("cap_quality"))


@query("s1_quarantine", oracle("SELECT k AS page, 'bad_number' AS reason FROM firsts WHERE wrong", "firsts"))
def quarantined(spark, sf_dir):
    return pl.new_pools(pool_documents(spark, sf_dir))[1].select("page", "reason")


@query("s2_pool_attributes", oracle("SELECT count(*) AS pools, count(*) FILTER (cap_quality = 'fresh') AS with_cap, CAST(sum(k % 9) AS BIGINT) AS buys_m5, count(*) FILTER (k % 3 = 0) AS with_volume FROM newp", "newp"))
def pool_attributes(spark, sf_dir):
    rows, _ = pl.new_pools(pool_documents(spark, sf_dir))
    return rows.agg(
        F.count(F.lit(1)).alias("pools"), F.count("market_cap_usd.value").alias("with_cap"), F.sum("buys_m5.value").cast("bigint").alias("buys_m5"),
        F.count("volume_h1_usd.value").alias("with_volume"),
    )


@query("s3_momentum_pools", oracle("SELECT run_id, chain, source, count(*) AS returned_items, count(DISTINCT token_id) FILTER (NOT (bad AND pos = 0)) AS unique_candidates, CASE WHEN bool_or(bad AND pos = 0 AND coalesce(2 * k < good, true)) THEN 'bad_number' END AS first_error FROM (SELECT *, min(2 * k + pos) FILTER (NOT (bad AND pos = 0)) OVER (PARTITION BY run_id, source, token_id) AS good FROM pools2) GROUP BY 1, 2, 3", "pools2"))
def momentum_pools(spark, sf_dir):
    return pl.momentum_pools(pool_documents(spark, sf_dir))[1].select("run_id", "chain", "source", "returned_items", "unique_candidates", "first_error")


def broken(docs, key, every, text="{broken"):
    """The same documents, every so manieth one replaced by text that is no such document."""
    return docs.withColumn("payload", F.when(key % every == 0, text).otherwise(F.col("payload")))


@query("s3_quarantine", oracle("SELECT o_orderkey AS page, 'unreadable' AS reason FROM orders WHERE o_orderkey % 19 = 0"))
def momentum_quarantine(spark, sf_dir):
    return pl.momentum_pools(broken(pool_documents(spark, sf_dir), F.col("page"), 19))[2].select("page", "reason")


@query("s5_quarantine", oracle("SELECT CAST(c_custkey AS VARCHAR) AS file, 'unreadable' AS reason FROM customer WHERE c_custkey % 7 = 0"))
def pair_quarantine(spark, sf_dir):
    return pl.token_pairs(broken(pair_documents(spark, sf_dir), F.col("file").cast("bigint"), 7, "[{"))[1].select("file", "reason")


@query("s7_quarantine", oracle("SELECT p_partkey AS file, 'unreadable' AS reason FROM part WHERE p_partkey % 5 = 0"))
def boost_quarantine(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    item = F.struct(F.lit("bsc").alias("chainId"), F.concat(F.lit("Boost"), "p_partkey").alias("tokenAddress"))
    docs = p.select(F.to_json(F.array(item)).alias("payload"), F.col("p_partkey").alias("file"), F.current_timestamp().alias("collected_at"))
    return pl.boost_seeds(broken(docs, F.col("file"), 5, "not json"))[1].select("file", "reason")


@query("s8_quarantine", oracle("SELECT s_suppkey AS file, CASE WHEN s_suppkey % 4 = 0 THEN 'unreadable' ELSE 'refused' END AS reason FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 4 = 1"))
def derivatives_quarantine(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(F.when(k % 4 == 1, "50011").otherwise("0").alias("code"), F.array(F.struct(k.cast("string").alias("instId"), F.lit("1").alias("oiUsd"))).alias("data")))
    docs = broken(s.select(body.alias("payload"), k.alias("file")), F.col("file"), 4)
    docs = docs.withColumn("batch", F.col("file"))
    none = docs.limit(0)
    return pl.derivatives_batch(none.withColumn("collected_at", F.current_timestamp()), none, docs, none)[2].select(F.col("batch").alias("file"), "reason")


@query("j1_included_token_lookup", oracle("SELECT k AS page, CAST(pos AS BIGINT) AS pos, token_id, CASE WHEN pos = 0 AND k % 4 <> 0 THEN 'SYM' ELSE '' END AS symbol FROM pools2", "pools2"))
def included_token_lookup(spark, sf_dir):
    rows = pl.flat_pools(pl.parse(pool_documents(spark, sf_dir), pl.POOLS))
    return rows.select("page", F.col("pos").cast("bigint").alias("pos"), "token_id", "symbol")


def trade_documents(spark, sf_dir):
    """Three trades per order; every thirteenth document names an unknown side."""
    o = ad.table(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")

    def trade(address, kind, usd, back):
        return F.struct(F.struct(
            address.alias("tx_from_address"), kind.alias("kind"), usd.alias("volume_in_usd"), iso(F.timestamp_micros(micros(at) - back)).alias("block_timestamp"),
        ).alias("attributes"))

    data = F.array(
        trade(F.lit("Aa"), F.when(k % 13 == 0, "swap").otherwise("buy"), F.format_string("%.2f", "o_totalprice"), F.lit(0)),
        trade(F.lit("aA"), F.lit("sell"), F.lit("25"), F.lit(5 * MINUTE)),
        trade(F.lit("cc"), F.lit("buy"), F.lit("10"), (k % 12) * MINUTE),
    )
    return o.select(
        F.to_json(F.struct(data.alias("data"))).alias("payload"), F.when(k % 2 == 0, "bsc").otherwise("solana").alias("chain"), k.alias("pool"), at.alias("collected_at"),
    )


@query("s4_pool_trades", oracle("""SELECT o_orderkey AS pool, CAST(2 + CAST(o_orderkey % 12 <= 5 AS INTEGER) - 1 AS BIGINT) AS buys, CAST(1 AS BIGINT) AS sells, CAST(1 + CAST(o_orderkey % 12 <= 5 AS INTEGER) AS BIGINT) AS unique_buyers,
  round(o_totalprice + CASE WHEN o_orderkey % 12 <= 5 THEN 10 ELSE 0 END, 2) AS buy_volume_usd FROM orders WHERE o_orderkey % 13 <> 0"""))
def pool_trades(spark, sf_dir):
    rows, _ = pl.pool_trades(trade_documents(spark, sf_dir))
    stats = tr.window_stats(tr.label_windows(rows, "collected_at"), ["pool"])
    return stats.filter(F.col("trade_window") == "current").select("pool", "buys", "sells", "unique_buyers", F.round("buy_volume_usd", 2).alias("buy_volume_usd"))


@query("s4_trade_quarantine", oracle("SELECT o_orderkey AS pool, 'unknown_side' AS reason FROM orders WHERE o_orderkey % 13 = 0"))
def trade_quarantine(spark, sf_dir):
    return pl.pool_trades(trade_documents(spark, sf_dir))[1].select("pool", "reason")


def pair_documents(spark, sf_dir):
    """Two pairs per customer with links and boosts."""
    c = ad.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")

    def pair(name, liq):
        return F.struct(
            F.lit("bsc").alias("chainId"), F.concat(F.lit(name), k).alias("pairAddress"),
            F.struct(F.concat(F.lit("TOKEN"), k % 300).alias("address"), F.col("c_name").alias("name"), F.lit("T").alias("symbol")).alias("baseToken"),
            F.format_string("%.2f", "c_acctbal").alias("priceUsd"), F.struct(liq.alias("usd")).alias("liquidity"),
            F.when(k % 3 != 0, F.lit(1700000000000) + k * 1000).alias("pairCreatedAt"),
            F.struct(
                F.array(F.struct(F.lit("site").alias("label"), F.when(k % 2 == 0, "https://a").otherwise("").alias("url"))).alias("websites"),
                F.array(
                    F.struct(F.lit("Twitter").alias("type"), F.lit("https://x").alias("url")), F.struct(F.lit("discord").alias("type"), F.lit("https://d").alias("url")),
                ).alias("socials"),
            ).alias("info"), F.struct(F.when(k % 5 == 0, k).alias("active")).alias("boosts"),
        )

    docs = F.array(pair("P", F.when(k % 4 != 0, F.col("c_acctbal") + 2000)), pair("Q", F.col("c_acctbal") + 1000))
    return c.select(F.to_json(docs).alias("payload"), k.cast("string").alias("file"), F.lit("2024-01-01").cast("timestamp").alias("collected_at"))


@query("s5_token_pairs", oracle("""SELECT CAST(c_custkey AS VARCHAR) AS file, CAST(p AS BIGINT) AS pos, 'bsc:token' || (c_custkey % 300) AS token_id, CASE p WHEN 0 THEN 'p' ELSE 'q' END || c_custkey AS pair_address, c_acctbal AS price_usd,
  CASE WHEN p = 0 AND c_custkey % 4 = 0 THEN 'missing' ELSE 'fresh' END AS liquidity_quality, CASE WHEN c_custkey % 3 <> 0 THEN 1700000000000000 + c_custkey * 1000000 END AS created_us FROM customer CROSS JOIN (VALUES (0), (1)) v(p)"""))
def token_pairs(spark, sf_dir):
    return pl.token_pairs(pair_documents(spark, sf_dir))[0].select(
        "file", F.col("pos").cast("bigint").alias("pos"), "token_id", "pair_address", F.col("price_usd.value").alias("price_usd"),
        F.col("liquidity.quality").alias("liquidity_quality"), micros("pair_created_at").alias("created_us"),
    )


@query("s6_links", oracle("SELECT CAST(c_custkey AS VARCHAR) AS file, CASE WHEN c_custkey % 2 = 0 THEN 'website,x,other' ELSE 'x,other' END AS kinds FROM customer"))
def link_kinds(spark, sf_dir):
    rows = pl.token_pairs(pair_documents(spark, sf_dir))[0].filter(F.col("pos") == 0)
    return rows.select("file", F.array_join(F.transform("links", lambda l: l["kind"]), ",").alias("kinds"))


@query("s7_boost_seeds", oracle("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'bsc:boost' ELSE 'solana:Boost' END || p_partkey AS token_id, 'DEX_BOOST_TOP' AS source FROM part WHERE p_partkey % 3 < 2"))
def boost_seeds(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    item = F.struct(F.when(k % 3 == 0, "bsc").when(k % 3 == 1, "solana").otherwise("base").alias("chainId"), F.concat(F.lit("Boost"), k).alias("tokenAddress"))
    docs = p.select(F.to_json(F.array(item)).alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("collected_at"))
    return pl.boost_seeds(docs)[0].select("token_id", F.col("momentum_sources")[0].alias("source"))


def derivative_documents(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    k, at = F.col("s_suppkey"), F.lit("2024-01-01").cast("timestamp")
    iid = F.concat(F.lit("S"), k, F.lit("-USDT-SWAP")).alias("instId")

    def doc(item):
        body = F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), F.array(item).alias("data")))
        return s.select(body.alias("payload"), F.lit(1).alias("batch"), at.alias("collected_at"))

    return (
        doc(F.struct(
            iid, F.when(k % 2 == 0, F.concat(F.lit("B"), k)).otherwise("").alias("baseCcy"), F.when(k % 5 == 0, "3").when(k % 5 == 4, "2").otherwise("1").alias("instCategory"),
            F.when(k % 10 == 7, "pre_market").otherwise("normal").alias("ruleType"), F.when(k % 11 == 0, "suspend").otherwise("live").alias("state"),
            F.when(k % 6 == 0, "").otherwise("1600000000000").alias("listTime"), F.lit("0.01").alias("tickSz"),
        )),
        doc(F.struct(iid, F.when(k % 13 == 0, "x").otherwise(F.format_string("%.2f", F.abs("s_acctbal") + 1)).alias("last"), F.lit("100").alias("open24h"), F.lit("5").alias("volCcy24h"), F.lit("1700000000000").alias("ts"))),
        doc(F.struct(iid, F.when(k % 3 == 0, "bad").otherwise("1000").alias("oiUsd"))),
        doc(F.struct(iid, F.lit("0.0001").alias("fundingRate"))),
    )


define("derivdoc", """SELECT s_suppkey AS k, 'S' || s_suppkey || '-USDT-SWAP' AS instrument_id, CASE WHEN s_suppkey % 5 = 0 THEN 'stock' ELSE 'crypto' END AS asset_class, abs(s_acctbal) + 1 AS price, s_suppkey % 13 = 0 AS bad FROM supplier
  WHERE s_suppkey % 5 <> 4 AND s_suppkey % 10 <> 7 AND s_suppkey % 11 <> 0""")


@query("s8_derivatives_batch", oracle("SELECT instrument_id, asset_class, round(price, 2) AS price_usd, CASE WHEN k % 3 <> 0 THEN CAST(1000 AS DOUBLE) END AS open_interest_usd, k % 6 <> 0 AS listed FROM derivdoc WHERE NOT bad", "derivdoc"))
def derivatives_batch(spark, sf_dir):
    rows, _, _ = pl.derivatives_batch(*derivative_documents(spark, sf_dir))
    return rows.select("instrument_id", "asset_class", F.round("price_usd", 2).alias("price_usd"), "open_interest_usd", F.col("listed_at").isNotNull().alias("listed"))


@query("s9_derived_ticker", oracle("SELECT instrument_id, CASE WHEN k % 2 = 0 THEN 'B' || k ELSE 'S' || k END AS symbol, round((round(price, 2) / 100 - 1) * 100, 6) AS change_24h_pct, round(5 * round(price, 2), 4) AS turnover_24h_usd FROM derivdoc WHERE NOT bad", "derivdoc"))
def derived_ticker(spark, sf_dir):
    rows, _, _ = pl.derivatives_batch(*derivative_documents(spark, sf_dir))
    return rows.select("instrument_id", "symbol", (F.round("change_24h_pct", 6) + 0.0).alias("change_24h_pct"), F.round("turnover_24h_usd", 4).alias("turnover_24h_usd"))


@query("j2_ticker_join_warnings", oracle("SELECT instrument_id, CASE WHEN bad THEN 'bad_last_price' ELSE 'bad_listing' END AS warning FROM derivdoc WHERE bad OR k % 6 = 0", "derivdoc"))
def ticker_warnings(spark, sf_dir):
    return pl.derivatives_batch(*derivative_documents(spark, sf_dir))[1].select("instrument_id", "warning")


def candle_documents(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    k, price = F.col("p_partkey"), F.format_string("%.2f", "p_retailprice")
    text = lambda c: c.cast("string")

    def row(ms, high, done):
        return F.array(text(ms), price, high, F.lit("1"), price, F.lit("10"), F.lit("0"), F.lit("100"), F.lit(done))

    high = F.when(k % 9 == 0, "0.5").otherwise("99999")
    t0 = F.lit(1700000000000) + k * 3_600_000
    data = F.array(row(t0 + 3_600_000, high, "0"), row(F.when(k % 10 == 0, t0 + 3_600_000).otherwise(t0), F.lit("99999"), "1"))
    return p.select(
        F.to_json(F.struct(F.lit("0").alias("code"), data.alias("data"))).alias("payload"), F.concat(F.lit("C"), k).alias("instrument_id"), F.lit("1H").alias("timeframe"),
    )


@query("s10_candles", oracle("""SELECT 'C' || p_partkey AS instrument_id, (1700000000000 + p_partkey * 3600000 + v * 3600000) * 1000 AS open_us, (1700000000000 + p_partkey * 3600000 + (v + 1) * 3600000) * 1000 AS close_us,
  round(p_retailprice, 2) AS close, CAST(100 AS DOUBLE) AS volume_quote, v = 0 AS confirmed FROM part CROSS JOIN (VALUES (0), (1)) x(v) WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 0"""))
def candles(spark, sf_dir):
    rows, _ = pl.candle_rows(candle_documents(spark, sf_dir))
    return rows.select("instrument_id", micros("open_time").alias("open_us"), micros("close_time").alias("close_us"), F.round("close", 2).alias("close"), "volume_quote", "confirmed")


@query("s10_candle_quarantine", oracle("SELECT 'C' || p_partkey AS instrument_id, CASE WHEN p_partkey % 9 = 0 THEN 'bad_row' ELSE 'repeated_time' END AS reason FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 10 = 0"))
def candle_quarantine(spark, sf_dir):
    return pl.candle_rows(candle_documents(spark, sf_dir))[1].select("instrument_id", "reason")


@query("t10_latest_candles", oracle("SELECT l_partkey AS instrument_id, epoch_us(l_shipdate) AS open_us, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS close FROM lineitem GROUP BY 1, 2"))
def latest_candles(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("instrument_id"), F.lit("1Dutc").alias("timeframe"), F.col("l_shipdate").cast("timestamp").alias("open_time"),
        F.col("l_extendedprice").alias("close"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ingested"),
    )
    return pl.latest_candles(li, "ingested").select("instrument_id", micros("open_time").alias("open_us"), "close")


@query("s13_json_decode", oracle("SELECT event_id, CAST(k AS DOUBLE) AS raw_score, CASE WHEN event_type = 'error' THEN 'missing' WHEN k % 2 = 0 THEN 'cached' ELSE 'fresh' END AS price_quality, k % 3 AS flags FROM ev", "ev"))
def json_decode(spark, sf_dir):
    e = ad._events(spark, sf_dir)
    flags = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), 1, F.col("k") % 3)
    stored = e.select(
        "event_id", F.when(F.col("k") % 4 != 0, F.col("k").cast("double")).alias("raw_score"), F.when(F.col("event_type") != "error", F.col("value")).alias("price_usd"),
        F.to_json(F.struct(F.lit("V1").alias("version"), F.col("k").cast("double").alias("raw_score"))).alias("score_breakdown_json"),
        F.to_json(flags).alias("risk_flags_json"),
        F.to_json(F.create_map(F.lit("price_usd"), F.when(F.col("k") % 2 == 0, "cached").otherwise("fresh"))).alias("data_quality_json"),
    )
    return pl.decode_snapshot(stored).select("event_id", F.col("score_breakdown.raw_score").alias("raw_score"), "price_quality", F.size("risk_flags").alias("flags"))


@query("s14_schema_evolution", oracle("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN k END AS added FROM ev", "ev"))
def schema_evolution(spark, sf_dir):
    e = ad._events(spark, sf_dir)
    older = e.filter(F.col("event_id") % 2 == 0).select("event_id")
    newer = e.filter(F.col("event_id") % 2 == 1).select("event_id", F.col("k").alias("added"))
    return pl.evolve(older, newer)
