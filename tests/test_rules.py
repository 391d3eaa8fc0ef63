"""Worked examples and boundary values of the domain rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quality as q
from tidemark.functions.timecol import HOUR, MINUTE
from tidemark.operators import candidates as ca, generations as ge, history as hi, opportunity as op, registry as rg, scoring as sc, study as st, trades as tr, universe as un
from tidemark.sinks import tables as tb
from tidemark.sources import payloads as pl

T0 = dt.datetime(2026, 1, 1, 12, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_trade_windows(spark):
    rows = [("p", "a", "buy", 100.0, at(-1)), ("p", "a", "buy", 50.0, at(0)), ("p", "b", "sell", 25.0, at(-5)),
            ("p", "c", "buy", 60.0, at(-6)), ("p", "d", "sell", 40.0, at(-10)), ("p", "e", "buy", 9.0, at(-11)), ("p", "f", "buy", 9.0, at(1))]
    df = spark.createDataFrame(rows, ["pool", "address", "side", "volume_usd", "traded_at"]).withColumn("t", F.lit(T0))
    out = tr.windows_side_by_side(tr.window_stats(tr.label_windows(df, "t"), ["pool"]), ["pool"]).collect()[0]
    cur, prev = out["current"], out["previous"]
    assert (cur["buys"], cur["sells"], cur["unique_buyers"], cur["unique_sellers"]) == (2, 1, 1, 1)
    assert (cur["buy_volume_usd"], cur["sell_volume_usd"]) == (150.0, 25.0)
    assert cur["top_share"] == pytest.approx(150 / 175) and prev["top_share"] == pytest.approx(0.6)
    assert (prev["buys"], prev["sells"]) == (1, 1)


def test_ratios_and_ladders(spark):
    row = spark.range(1).select(
        q.open_ratio(F.lit(3), F.lit(0)).alias("inf"), q.open_ratio(F.lit(0), F.lit(0)).alias("zero"),
        q.open_ratio(F.lit(3), F.lit(-1)).alias("neg"),
        q.evidence_ratio(q.tagged(F.lit(1.0), F.lit("fresh")), q.tagged(F.lit(-1.0), F.lit("fresh"))).alias("none"),
        q.ladder(F.lit(float("inf")), q.VELOCITY_LADDER, 20.0).alias("top"), q.ladder(F.lit(1.0999), q.VELOCITY_LADDER, 20.0).alias("low"),
        q.tagged(F.lit(1.0), F.lit("stale"))["value"].alias("unknown"),
    ).collect()[0]
    assert row["inf"] == float("inf") and row["zero"] == 0 and row["neg"] == 0 and row["none"] is None
    assert row["top"] == 20.0 and row["low"] == 0.0 and row["unknown"] is None


def score(spark, champion=None, **values):
    names = ["liquidity_usd", "market_cap_usd", "volume_m5_usd", "buys_m5", "sells_m5", "buyers_m5", "buyer_velocity", "volume_velocity", "buy_volume_m5_usd",
             "sell_volume_m5_usd", "participant_growth", "social_momentum", "token_age_seconds", "top10_holder_percent", "concentrated_activity",
             "suspected_bot_activity", "strong_dev_selling"]
    cols = [q.fresh_or_missing(F.lit(values.get(n)).cast("double")).alias(n) for n in names]
    return sc.score(spark.range(1).select(*cols), champion or sc.default_config()).collect()[0]


def test_score_caps_gates_and_risks(spark):
    full = dict(buyer_velocity=4.0, volume_velocity=4.0, buys_m5=8, sells_m5=2, participant_growth=4.0, liquidity_usd=20000.0, market_cap_usd=100000.0)
    best = score(spark, **full, token_age_seconds=60.0)
    assert best["raw_score"] == 100.0 and best["raw_tier"] == "BREAKOUT" and best["evidence_confidence"] == "HIGH"
    assert best["available_maximum"] == 85.0 and best["age_bonus"] == 10.0
    thin = score(spark, buyer_velocity=4.0, volume_velocity=4.0)
    assert thin["raw_tier"] == "BREAKOUT" and thin["effective_tier"] == "WATCH" and thin["evidence_confidence"] == "LOW"
    risky = score(spark, **{**full, "liquidity_usd": 1999.0}, top10_holder_percent=81.0, strong_dev_selling=1.0)
    assert risky["risk_penalty"] == 70.0 and risky["risk_flags"] == ["HIGH_CONCENTRATION", "LOW_LIQUIDITY", "STRONG_DEV_SELLING"]
    empty = score(spark)
    assert empty["raw_score"] == 0.0 and empty["raw_tier"] == "HIDDEN"
    with pytest.raises(ValueError):
        sc.score(spark.range(1), sc.default_config("a"), [sc.default_config("a")])


def test_episode_example(spark):
    minutes = list(range(0, 45, 5))
    runs = spark.createDataFrame([(i + 1, "crypto", "completed", at(m)) for i, m in enumerate(minutes)], ["run_id", "asset_class", "status", "finished_at"])
    listed = [(1, 100.0), (2, 101.0), (4, 103.0), (9, 110.0)]
    members = spark.createDataFrame([(r, "X", "X", p) for r, p in listed], ["run_id", "instrument_id", "symbol", "price"])
    rows = hi.episodes(runs, members, F.lit(at(0)), F.lit(at(60))).orderBy("episode").collect()
    assert (rows[0]["appearances"], rows[0]["experienced_scans"], rows[0]["ended_at"]) == (3, 7, at(30))
    assert rows[1]["first_price"] == 110.0 and rows[1]["status"] == "active"


def test_statistics_example(spark):
    rows = []
    for i in range(10):
        entry = "EVALUABLE" if i < 8 else "UNAVAILABLE_PRICE"
        status = "MATURED" if i < 4 else "INSUFFICIENT_DATA" if i < 6 else "PENDING" if i < 8 else "NOT_EVALUABLE"
        r = [0.1, 0.2, 0.3, -0.1][i] if i < 4 else None
        rows.append((f"t{i}", "BACKFILL" if i % 2 else "LIVE", "bsc" if i % 3 else "base", "HIGH", "V", 55, "1h", entry, status, r, 0.3 if i < 4 else None, -0.15 if i < 4 else None))
    df = spark.createDataFrame(rows, "token_id string, signal_source string, chain string, evidence_confidence string, score_version string, threshold bigint, horizon string, entry_status string, status string, return_decimal double, mfe_decimal double, mae_decimal double")
    stats = st.threshold_statistics(df, df.select("score_version").distinct())
    assert stats.count() == 2016
    cell = stats.filter("signal_source_scope='ALL' AND chain_scope='ALL' AND evidence_scope='ALL' AND threshold=55 AND horizon='1h'").collect()[0]
    assert (cell["signals"], cell["evaluable"], cell["pending"], cell["matured"], cell["insufficient"]) == (10, 8, 2, 4, 2)
    assert cell["entry_price_coverage"] == 0.8 and cell["maturity_coverage"] == 0.75 and cell["positive_return_rate"] == 0.75
    assert cell["result_coverage"] == pytest.approx(2 / 3) and cell["median_return"] == pytest.approx(0.15)
    assert cell["median_mfe"] == 0.3 and cell["median_mae"] == -0.15 and cell["insufficient_sample"]
    none = stats.filter("signal_source_scope='ALL' AND chain_scope='SOLANA' AND threshold=60").collect()[0]
    assert none["signals"] == 0 and none["entry_price_coverage"] is None and none["median_return"] is None


def test_raw_score_88_gives_seven_signals(spark):
    rows = [(1, "t", at(0), "bsc", 1.0, 88.0, "HIGH", "V"), (2, "t", at(1), "bsc", 1.0, 89.0, "HIGH", "V")]
    df = spark.createDataFrame(rows, ["id", "token_id", "collected_at", "chain", "price_usd", "raw_score", "evidence_confidence", "score_version"])
    got = st.first_crossings(df, 0).collect()
    assert sorted(r["threshold"] for r in got) == [55, 60, 65, 70, 75, 80, 85] and {r["signal_snapshot_id"] for r in got} == {1}


def test_outcomes_use_the_frontier_and_no_future(spark):
    rows = [(1, "t", at(0), 10.0), (2, "t", at(3), 8.0), (3, "t", at(5), 12.0), (4, "t", at(5), 14.0), (5, "t", at(6), 99.0), (6, "u", at(8), 1.0)]
    snaps = spark.createDataFrame(rows, ["id", "token_id", "collected_at", "price_usd"])
    entries = st.paper_entries(spark.createDataFrame([("t", "V", 55, "bsc", "LIVE", 1, at(0), 10.0, 60.0, "HIGH")],
        "token_id string, score_version string, threshold bigint, chain string, signal_source string, signal_snapshot_id bigint, signal_at timestamp, price_usd double, raw_score double, evidence_confidence string"))
    hz = (st.Horizon("5m", 5 * MINUTE, 3 * MINUTE), st.Horizon("15m", 15 * MINUTE, 3 * MINUTE))
    observed = st.observe_horizons(entries, st.price_observations(snaps, F.lit(6)), hz)
    out = {r["horizon"]: r for r in st.evaluate_outcomes(st.expand_horizons(entries, hz), observed, F.lit(6), F.lit(at(18))).collect()}
    hit = out["5m"]
    assert (hit["status"], hit["selected_snapshot_id"]) == ("MATURED", 3) and hit["return_decimal"] == pytest.approx(0.2)
    assert hit["mfe_decimal"] == pytest.approx(0.4) and hit["mae_decimal"] == pytest.approx(-0.2)
    assert out["15m"]["status"] == "PENDING"
    later = st.evaluate_outcomes(st.expand_horizons(entries, hz), observed, F.lit(6), F.lit(at(18) + dt.timedelta(milliseconds=1))).collect()
    assert {r["horizon"]: r["status"] for r in later}["15m"] == "INSUFFICIENT_DATA"


def test_price_plan_accepts_and_rejects(spark):
    base = spark.range(1).select(
        F.lit(True).alias("long_allowed"), F.lit(80).alias("start_score"), F.lit(False).alias("high_volatility"), F.lit(110.0).alias("current_price"),
        F.lit(0.1).alias("tick_size"), F.struct(F.lit(4.0).alias("atr14")).alias("f4H"), F.struct(F.lit(100.0).alias("low"), F.lit(104.0).alias("high")).alias("support"),
        F.array(F.struct(F.lit(125.0).alias("low")), F.struct(F.lit(140.0).alias("low"))).alias("resistances"), F.lit(112.0).alias("confirmation_level"),
    )
    plan = op.price_plan(base).collect()[0]
    assert plan["plan_rejection"] is None
    assert (plan["entry_1"], plan["entry_2"], plan["entry_3"], plan["confirmation_entry"]) == (104.0, 102.0, 100.0, 112.0)
    assert plan["full_average_cost"] == pytest.approx(104.1) and plan["stop_price"] == 98.0
    assert (plan["target_1"], plan["target_2"]) == (125.0, 140.0) and plan["reward_risk_1"] == pytest.approx(20.9 / 6.1)
    cases = {"low_score": base.withColumn("start_score", F.lit(64)), "daily_veto": base.withColumn("long_allowed", F.lit(False)),
             "no_resistance": base.withColumn("resistances", F.expr("filter(resistances, x -> false)")), "bad_tick": base.withColumn("tick_size", F.lit(0.0)),
             "reward_too_low": base.withColumn("resistances", F.array(F.struct(F.lit(111.0).alias("low")))), "no_support": base.withColumn("support", F.expr("CAST(NULL AS struct<low:double,high:double>)"))}
    for code, df in cases.items():
        assert op.price_plan(df).collect()[0]["plan_rejection"] == code


def test_universe_bounds_and_single_pool(spark):
    now = F.lit(T0)
    rows = [("A-USDT-SWAP", "A", "crypto", 1.0, 1e7, 5e6, None, T0 - dt.timedelta(days=365), 0.1), ("B-USDT-SWAP", "B", "crypto", 1.0, 1e7 - 1, 5e6, None, T0 - dt.timedelta(days=400), 0.1)]
    df = spark.createDataFrame(rows, "instrument_id string, symbol string, asset_class string, price_usd double, turnover_24h_usd double, open_interest_usd double, funding_rate double, listed_at timestamp, tick_size double")
    got = un.build_universe(un.gate(df, now, "crypto")).collect()
    assert [(r["instrument_id"], r["liquidity_score"]) for r in got] == [("A-USDT-SWAP", 95.0)]


def test_config_rules(spark):
    good, bad = sc.default_config(), sc.default_config()
    bad["factors"]["buyer_velocity"]["velocity_thresholds"]["high"] = 5.0
    del bad["tiers"]["watch"]
    df = spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(bad))], ["n", "c"]).select("n", rg.config_violations(F.col("c")).alias("v"))
    got = {r["n"]: r["v"] for r in df.collect()}
    assert got["g"] == [] and {"tiers_keys", "buyer_velocity_thresholds"} <= set(got["b"])


def test_config_is_parsed_once(spark):
    df = spark.createDataFrame([("{",), (None,), (json.dumps(sc.default_config()),)], "c string").select(rg.config_violations(F.col("c")).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    broken, missing, good = [r["v"] for r in df.collect()]
    assert broken == missing and len(broken) == len(set(broken)) > 30 and good == []


def test_pool_payload_rules(spark):
    def pool(created, cap, ref="bsc_0xAB"):
        return {"attributes": {"address": "0xP", "pool_created_at": created, "base_token_price_usd": "1.5", "market_cap_usd": cap}, "relationships": {"base_token": {"data": {"id": ref}}}}
    ok = json.dumps({"data": [pool("2026-01-01T11:00:00Z", None), pool("2026-01-01T01:00:00Z", "1")], "included": []})
    broken = json.dumps({"data": [pool("2026-01-01T11:00:00Z", "x", "bsc_0xCD")], "included": []})
    df = spark.createDataFrame([(ok, "bsc", 1, 1, T0), (broken, "bsc", 2, 2, T0)], ["payload", "chain", "page", "run_id", "collected_at"])
    rows, quarantine = pl.new_pools(df)
    kept = rows.collect()
    assert [r["token_id"] for r in kept] == ["bsc:0xab"] and kept[0]["market_cap_usd"]["quality"] == "missing" and kept[0]["price_usd"]["value"] == 1.5
    assert [(r["page"], r["reason"]) for r in quarantine.collect()] == [(2, "bad_number")]


def test_bad_creation_time_is_found_in_the_document(spark):
    def pool(created, ref):
        return {"attributes": {"address": "0xP", "pool_created_at": created, "base_token_price_usd": "1.5"}, "relationships": {"base_token": {"data": {"id": ref}}}}
    docs = [json.dumps({"data": [pool("2026-01-01T11:00:00Z", "bsc_0xAB"), bad]}) for bad in (pool("soon", "bsc_0xCD"), None)] + ['{"data": []}', "{", json.dumps({"data": [pool("2026-01-01T11:00:00Z", "bsc_0xEF")]})]
    df = spark.createDataFrame([(d, "bsc", i, i, T0) for i, d in enumerate(docs)], ["payload", "chain", "page", "run_id", "collected_at"])
    rows, quarantine = pl.new_pools(df)
    assert [r["token_id"] for r in rows.collect()] == ["bsc:0xef"]
    assert sorted((r["page"], r["reason"]) for r in quarantine.collect()) == [(0, "bad_pool_created_at"), (1, "bad_pool_created_at"), (3, "unreadable")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # the one over chosen pools


def test_truncated_trades_and_bad_side(spark):
    def doc(n, side="buy"):
        return json.dumps({"data": [{"attributes": {"tx_from_address": "a", "kind": side, "volume_in_usd": "1", "block_timestamp": "2026-01-01T12:00:00Z"}} for _ in range(n)]})
    late = json.loads(doc(301))
    late["data"][300]["attributes"]["kind"] = "swap"
    df = spark.createDataFrame([(doc(301), "bsc", "p", T0), (doc(299), "bsc", "q", T0), (doc(1, "swap"), "bsc", "r", T0), (json.dumps(late), "bsc", "s", T0)], ["payload", "chain", "pool", "collected_at"])
    rows, bad = pl.pool_trades(df)
    got = {r["pool"]: (r["n"], r["t"]) for r in rows.groupBy("pool").agg(F.count("*").alias("n"), F.max("truncated").alias("t")).collect()}
    assert got == {"p": (301, True), "q": (299, False)} and sorted((r["pool"], r["reason"]) for r in bad.collect()) == [("r", "unknown_side"), ("s", "unknown_side")]


def test_numbers_are_plain_decimals(spark):
    texts = ["1.5", "-2e3", ".5", "7.", "+1", "1.5d", "3f", " 2 ", "", "NaN", "0x1", "1_0", "1e", "."]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pl.number(F.col("t")).alias("n")).collect()]
    assert got == [1.5, -2000.0, 0.5, 7.0, 1.0] + [None] * 9


def test_limits_are_the_callers(spark):
    snaps = spark.range(150).selectExpr("id", "'t' AS token_id", "timestamp_seconds(id) AS collected_at", "CAST(id AS DOUBLE) AS raw_score")
    assert ge.score_change(snaps, 150).collect()[0]["points"] == 150


def test_candidate_merge_order(spark):
    m = "named_struct('market_data_quality', q, 'evidence_count', 1, 'collected_at', t, 'pair_address', pair_address, 'price', price)"
    rows = [(1, "bsc", "0xA", "", "LAUNCH", "P1", "partial", 1.0), (2, "bsc", "0xa", "Name", "MOMENTUM", "P2", "full", 2.0), (3, "bsc", "0xA", "Other", "LAUNCH", "P3", "full", 3.0)]
    df = spark.createDataFrame(rows, ["seq", "chain", "address", "name", "origin", "pair_address", "q", "price"]).withColumn("t", F.lit(T0))
    df = df.withColumns({"symbol": F.lit(""), "momentum_sources": F.when(F.col("seq") == 2, F.array(F.lit("GECKO_TRENDING"))).otherwise(F.expr("CAST(array() AS array<string>)")),
                         "discovery_pool_address": F.lit(""), "discovery_pool_created_at": F.col("t"), "trigger_pool_address": F.lit(""), "trigger_pool_created_at": F.col("t"),
                         "chain_created_at": F.lit(None).cast("timestamp"), "detected_at": F.col("t")}).withColumn("market", F.expr(m))
    got = ca.merge_candidates(df, "seq").collect()
    assert len(got) == 1 and got[0]["token_id"] == "bsc:0xa" and got[0]["origin"] == "BOTH" and got[0]["name"] == "Name"
    assert got[0]["pair_address"] == "p2" and got[0]["market"]["price"] == 3.0 and got[0]["momentum_sources"] == ["GECKO_TRENDING"]


def test_token_upsert_keeps_first_seen(spark):
    schema = "token_id string, first_seen_price_usd double, name string, seen_at int"
    out = tb.upsert_tokens(spark.createDataFrame([("t", None, "old", 1)], schema), spark.createDataFrame([("t", 5.0, "new", 2)], schema)).collect()[0]
    assert out["first_seen_price_usd"] is None and out["name"] == "new"


def test_algorithm_key_compares_whole_configs(spark):
    texts = ['{"version": "a", "x": {"p": 1.0, "q": [2, 2.50]}}', '{"x": {"q": [2.0, 2.5], "p": 1}, "version": "b"}', '{"version": "a", "x": {"p": 1.0, "q": [2, 2.5], "r": 0}}', "[1]", "no"]
    keys = [r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rg.algorithm_key(F.col("t")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] is None and keys[4] is None
