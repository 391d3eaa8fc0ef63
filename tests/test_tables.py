"""Writers, immutability, streaming restarts and a sample of the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import *  # noqa: F401,F403
from tidemark.catalog import REGISTRY
from tidemark.catalog.study import HZ
from tidemark.operators import study as st
from tidemark.plans import outcome_study as plan
from tidemark.session import shared_dir
from tidemark.sinks import tables as tb
from tidemark.sources import adapters as ad
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_publish_replaces_only_its_runs(spark):
    path = shared_dir(spark, "opps")
    runs = spark.createDataFrame([(1, "completed", 1), (2, "failed", 1), (3, "degraded", 1)], ["run_id", "status", "finished_at"])
    rows = lambda *r: spark.createDataFrame(list(r), "run_id long, instrument_id string")
    stored = lambda: sorted(map(tuple, tb.published(spark, path).select("run_id", "instrument_id").collect()))
    tb.publish_runs(rows((1, "A"), (1, "B"), (2, "X"), (3, "C")), runs, path, 1)
    tb.publish_runs(rows((1, "Z")), runs.filter("run_id = 1"), path, 2)
    assert stored() == [(1, "Z"), (3, "C")]
    tb.publish_runs(rows(), runs.filter("run_id = 3"), path, 3)
    assert stored() == [(1, "Z")]


def test_analysis_runs_are_immutable(spark):
    path = shared_dir(spark, "runs")
    rows = spark.createDataFrame([("ALL", "ALL", "ALL", "V", 55, "1h", 1)], ["signal_source_scope", "chain_scope", "evidence_scope", "score_version", "threshold", "horizon", "signals"])
    plan.materialize(rows, 1, path)
    plan.materialize(rows.withColumn("signals", F.lit(2)), 2, path)
    with pytest.raises(ValueError):
        plan.materialize(rows, 2, path)
    assert [r["signals"] for r in plan.latest_analysis(spark.read.parquet(path)).collect()] == [2]


def shuffled(spark, df, files):
    """A folder of files that each hold some rows of any time."""
    path = shared_dir(spark, "shuffled")
    df.repartition(files).write.parquet(path)
    return path


def batches(path):
    return len([f for f in os.listdir(path) if f.endswith(".parquet")])


def same(got, want):
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_signals_do_not_depend_on_files(spark):
    scores = ad.snapshot_scores(spark, SF).select("token_id", "score_version", *st.FIELDS)
    source, root = shuffled(spark, scores, 7), shared_dir(spark, "sig")
    # The last files come first: the lowest ids are the latest to arrive.
    late = shared_dir(spark, "late")
    cut = scores.agg(F.max("id").alias("m")).first()["m"] // 2
    table = jobs.signal_table(spark, f"{root}/table", every=3)
    want = st.first_crossings(scores, 0)
    scores.filter(F.col("id") > cut).coalesce(1).write.parquet(late)
    jobs.signal_stream(jobs.file_stream(spark, late, files_per_batch=1), table, f"{root}/check", 0)
    first = table.read().select(*st.SIGNAL_KEY, "signal_snapshot_id")
    assert first.exceptAll(want.select(*first.columns)).count() > 0
    scores.filter(F.col("id") <= cut).coalesce(1).write.mode("append").parquet(late)
    for _ in range(2):
        jobs.signal_stream(jobs.file_stream(spark, late, files_per_batch=1), table, f"{root}/check", 0)
    same(table.read().select(*want.columns), want)
    other = jobs.signal_table(spark, f"{root}/other", every=3)
    jobs.signal_stream(jobs.file_stream(spark, source, files_per_batch=1), other, f"{root}/other-check", 0)
    same(other.read().select(*want.columns), want)
    assert batches(source) == 7 and other.version() > 0


def test_trade_windows_do_not_depend_on_files(spark):
    good = ad.trades(spark, SF).filter(F.col("side").isNotNull())
    kind = dict(good.dtypes)["pool"]
    tables = []
    for n, files in ((1, 64), (9, 1)):
        root = shared_dir(spark, "windows")
        table = jobs.TradeWindows(spark, root, "6 hours", pool_type=kind, every=4)
        table.consume(jobs.file_stream(spark, shuffled(spark, good, n), files_per_batch=files), f"{root}/check")
        tables.append(table)
    whole, pieces = (t.closed().drop("version").withColumn("buy_volume_usd", F.round("buy_volume_usd", 4)).withColumn("sell_volume_usd", F.round("sell_volume_usd", 4)).withColumn("top_share", F.round("top_share", 6)) for t in tables)
    same(pieces, whole)
    assert tables[0].late() is None and tables[0].reached() == tables[1].reached() == good.agg(F.max("traded_at").alias("t")).first()["t"]
    late = tables[1].late()
    assert late.count() > 0 and late.filter("window_end > traded_at + INTERVAL 6 HOURS").count() == 0
    changed = tables[1].closed().groupBy().agg(F.max("version").alias("v")).first()["v"]
    assert changed == late.agg(F.max("batch_id").alias("b")).first()["b"]


def test_frontier_waits_for_every_file_of_a_batch(spark):
    rows = lambda *m: spark.createDataFrame([("p", "a", "buy", 1.0, i) for i in m], "pool string, address string, side string, volume_usd double, m long").withColumn("traded_at", F.timestamp_seconds(F.col("m") * 60)).drop("m")
    source, root = shared_dir(spark, "two"), shared_dir(spark, "windows")
    for m in ((1, 20), (2, 9)):
        rows(*m).coalesce(1).write.mode("append").parquet(source)
    table = jobs.TradeWindows(spark, root, "5 minutes")
    table.consume(jobs.file_stream(spark, source, files_per_batch=2), f"{root}/check")
    assert table.closed().count() == 1 and table.closed().first()["buys"] == 2
    rows(3, 11).coalesce(1).write.mode("append").parquet(source)
    table.consume(jobs.file_stream(spark, source, files_per_batch=2), f"{root}/check")
    assert sorted((r["buys"], r["version"]) for r in table.closed().collect()) == [(1, 0), (3, 1)]
    assert [r["batch_id"] for r in table.late().collect()] == [1]


def test_outcomes_do_not_depend_on_files(spark):
    snaps = ad.snapshots(spark, SF)
    entries = st.paper_entries(st.first_crossings(ad.scores_from(snaps), 0))
    snaps = snaps.filter("id < 700")  # the windows of later signals stay open
    where = shared_dir(spark, "pending")
    st.expand_horizons(entries, HZ).filter(F.col("status") == "PENDING").write.parquet(where)
    stored = lambda: spark.read.parquet(where)
    found = []
    for n, files in ((1, 64), (6, 1)):
        root = shared_dir(spark, "outcomes")
        outcomes = jobs.Outcomes(spark, root, every=4)
        outcomes.consume(jobs.file_stream(spark, shuffled(spark, snaps, n), files_per_batch=files), stored, f"{root}/check", max(h.tolerance for h in HZ))
        found.append(outcomes.settled(stored()))
    same(*found)
    assert {r["status"] for r in found[0].select("status").distinct().collect()} == {"MATURED", "INSUFFICIENT_DATA", "PENDING"}


def test_latest_state_does_not_depend_on_files(spark):
    obs = ad.snapshots(spark, SF).select("token_id", F.col("id").alias("seq"), F.col("collected_at").alias("observed_at"), "price_usd")
    found = []
    for n, files in ((1, 64), (5, 1)):
        root = shared_dir(spark, "state")
        table = jobs.state_table(spark, f"{root}/table", "token_id string, seq long, observed_at timestamp, price_usd double", every=2)
        jobs.latest_state_stream(jobs.file_stream(spark, shuffled(spark, obs, n), files_per_batch=files), table, f"{root}/check")
        found.append(table.read())
    same(*found)


def test_episodes_do_not_depend_on_batches(spark):
    source = shared_dir(spark, "presences")
    for part in ([1, 2, 10, 11], [3, 4, 2], [20, 4], [30], [16, 24], [11]):
        spark.createDataFrame([("c", "I", s) for s in part], ["asset_class", "instrument_id", "seq"]).coalesce(1).write.mode("append").parquet(source)
    for files in (1, 9):
        root = shared_dir(spark, "episodes")
        table = jobs.episode_table(spark, f"{root}/table", every=2)
        jobs.presence_stream(jobs.file_stream(spark, source, files_per_batch=files), table, f"{root}/checkpoint")
        got = sorted((r["first_seq"], r["last_seq"], r["appearances"], r["closed"]) for r in jobs.read_episodes(table).collect())
        assert got == [(1, 4, 4, True), (10, 11, 2, True), (16, 16, 1, True), (20, 20, 1, True), (24, 24, 1, True), (30, 30, 1, False)]
    bridge = shared_dir(spark, "bridge")
    spark.createDataFrame([("c", "I", s) for s in (7, 13, 18, 22)], ["asset_class", "instrument_id", "seq"]).write.parquet(bridge)
    more = spark.readStream.schema("asset_class string, instrument_id string, seq long").parquet(bridge)
    jobs.presence_stream(more, jobs.episode_table(spark, f"{root}/table2"), f"{root}/check2")
    whole = table.merge(table.read().unionByName(jobs.episode_table(spark, f"{root}/table2").read()))
    assert sorted((r["first_seq"], r["last_seq"], r["appearances"]) for r in whole.collect()) == [(1, 24, 13), (30, 30, 1)]


def test_keyed_table_is_bounded_and_takes_repeats(spark):
    from tidemark.streaming.keyed import KeyedTable

    path = shared_dir(spark, "keyed")
    add = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    table = KeyedTable(spark, path, "k string, n long", ("k",), add, buckets=4, every=3)
    rows = lambda b: spark.createDataFrame([(f"k{b % 5}", 1), ("hot", 1)], "k string, n long").coalesce(1)
    count = lambda: sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs)
    sizes = []
    for b in range(14):
        for _ in range(2 if b in (2, 4, 5, 9) else 1):
            table.apply(rows(b), b)
        sizes.append(count())
        assert table.holds(b) and not table.holds(b + 1)
    assert {r["k"]: r["n"] for r in table.read().collect()} == {"hot": 14, "k0": 3, "k1": 3, "k2": 3, "k3": 3, "k4": 2}
    assert table.version() == 11 and max(sizes) <= 3 * 2 + 2 * 4 + 2 + 1
    assert table.read(before=13).filter("k = 'hot'").first()["n"] == 13


def test_snapshot_append_partitions_by_day(spark):
    path = shared_dir(spark, "snaps")
    tb.append_snapshots(ad.snapshots(spark, SF), path)
    back = spark.read.parquet(path)
    assert back.count() == ad.snapshots(spark, SF).count() and "dt" in back.columns


def test_files_of_a_day_follow_its_volume(spark):
    path = shared_dir(spark, "snaps")
    day = F.when(F.col("id") % 50 == 0, F.lit("2024-01-02 01:00:00")).otherwise(F.lit("2024-01-01 01:00:00")).cast("timestamp")
    rows = spark.range(0, 60_000, 1, 12).withColumn("token_id", F.sha2(F.col("id").cast("string"), 256)).withColumn("collected_at", day)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        tb.append_snapshots(rows, path)
    finally:
        spark.conf.set(name, before)
    files = {d: len([f for f in os.listdir(f"{path}/dt={d}") if f.endswith(".parquet")]) for d in ("2024-01-01", "2024-01-02")}
    assert files["2024-01-01"] >= 6 and files["2024-01-02"] == 1
    assert spark.read.parquet(path).count() == 60_000


def test_report_files(spark):
    json_path, text_path = shared_dir(spark, "json"), shared_dir(spark, "text")
    stats = REGISTRY["a12_threshold_statistics"].run(spark, SF)
    tb.write_report_json(stats, json_path)
    tb.write_report_text(st.report_lines(stats), text_path)
    assert spark.read.json(json_path).count() == spark.read.text(text_path).count() > 0


SAMPLE = [
    "a1_trade_window_stats", "c8_multi_version_scores", "c11_candidate_merge", "c21_liquid_universe", "j3_asof_strict", "j7_current_generation",
    "l4_outcomes", "o7_bounded_universe", "p13_preliminary_score", "r1_config_violations", "s1_new_pools", "s10_candles", "t5_tumbling_windows",
    "w22_episodes", "w25_resampled_bars", "c19_stage",
]


@pytest.mark.parametrize("name", sorted(REGISTRY) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, name):
    from tools.check_queries import duck, rows_of

    q = REGISTRY[name]
    df = q.run(spark, SF)
    got = rows_of((df.columns, [tuple(r) for r in df.collect()]))
    cur = duck(SF).execute(q.sql)
    assert got == rows_of(([d[0] for d in cur.description], cur.fetchall()))
