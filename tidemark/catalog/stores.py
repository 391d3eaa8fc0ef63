"""Queries on stored-table rules and the score registry."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import DAY, micros
from tidemark.operators import registry as rg, scoring as sc
from tidemark.sinks import tables as tb
from tidemark.sources import adapters as ad


def tokens(spark, sf_dir, parity):
    """Order rows as token observations: even keys are the stored side, odd ones the incoming side."""
    o = ad.table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == parity)
    return o.select(
        F.col("o_custkey").cast("string").alias("token_id"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        F.col("o_totalprice").alias("first_seen_price_usd"), F.col("o_orderpriority").alias("name"),
        F.struct(F.lit(parity).alias("batch"), micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_orderkey").alias("k")).alias("seen_at"),
    )


@query("k2_token_upsert", oracle("""SELECT CAST(o_custkey AS VARCHAR) AS token_id, arg_min(o_totalprice, (o_orderkey % 2, o_orderdate, o_orderkey)) AS first_seen_price_usd, arg_max(o_orderpriority, (o_orderkey % 2, o_orderdate, o_orderkey)) AS name FROM orders GROUP BY 1"""))
def token_upsert(spark, sf_dir):
    return tb.upsert_tokens(tokens(spark, sf_dir, 0), tokens(spark, sf_dir, 1)).select("token_id", "first_seen_price_usd", "name")


def line_scores(spark, sf_dir):
    """Line items as version scores of their order; some orders break a rule."""
    li = ad.table(spark, sf_dir, "lineitem")
    ln, k = F.col("l_linenumber"), F.col("l_orderkey")
    version = F.concat(F.lit("V"), F.when(k % 10 == 0, 1).otherwise(ln))
    return li.select(
        k.alias("snapshot_id"), version.alias("score_version"), F.when(ln == 1, "CHAMPION").when(k % 17 == 0, "RETIRED").otherwise("CHALLENGER").alias("evaluation_role"),
        F.when(k % 19 == 0, "other").otherwise(version).alias("breakdown_version"), F.col("l_discount").alias("raw_score"), F.col("l_returnflag").alias("effective_tier"),
    )


define("ls", """SELECT l_orderkey AS k, 'V' || CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE l_linenumber END AS v, CASE WHEN l_linenumber = 1 THEN 'CHAMPION' WHEN l_orderkey % 17 = 0 THEN 'RETIRED' ELSE 'CHALLENGER' END AS role,
  l_orderkey % 19 = 0 AS mism, l_discount AS score, l_returnflag AS tier FROM lineitem""")
define("lsp", """SELECT k, CASE WHEN count(*) > count(DISTINCT v) THEN 'duplicate_version' WHEN bool_or(mism) THEN 'breakdown_version' WHEN bool_or(role = 'RETIRED') THEN 'invalid_role'
  WHEN count(*) FILTER (role = 'CHAMPION') <> 1 THEN 'champion_count' WHEN count(*) FILTER (role = 'CHALLENGER') > 3 THEN 'too_many_challengers' END AS problem FROM ls GROUP BY 1""", "ls")


@query("k3_score_set_problems", oracle("SELECT k AS snapshot_id, problem FROM lsp WHERE problem IS NOT NULL", "lsp"))
def score_set_problems(spark, sf_dir):
    return tb.score_set_problems(line_scores(spark, sf_dir))


@query("k3_valid_scores", oracle("SELECT ls.k AS snapshot_id, ls.v AS score_version, ls.role AS evaluation_role FROM ls JOIN lsp USING (k) WHERE problem IS NULL", "ls", "lsp"))
def valid_scores(spark, sf_dir):
    return tb.valid_scores(line_scores(spark, sf_dir)).select("snapshot_id", "score_version", "evaluation_role")


@query("k4_champion_projection", oracle("SELECT o_orderkey AS id, score, tier, v AS score_version FROM orders JOIN ls ON k = o_orderkey JOIN lsp USING (k) WHERE role = 'CHAMPION' AND problem IS NULL", "ls", "lsp"))
def champion_projection(spark, sf_dir):
    snaps = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return tb.project_champion(snaps, tb.valid_scores(line_scores(spark, sf_dir)))


@query("k5_publishable_rows", oracle("SELECT m.run_id, m.instrument_id FROM members m JOIN runs r USING (run_id) WHERE r.status <> 'failed'", "members", "runs"))
def publishable_rows(spark, sf_dir):
    return tb.publishable(ad.run_members(spark, sf_dir), ad.opportunity_runs(spark, sf_dir))[0].select("run_id", "instrument_id")


@query("k6_append_derivatives", oracle("""SELECT instrument_id, hour, min(id) AS id FROM (SELECT *, t // 3600000000 AS hour FROM deriv) WHERE (instrument_id, hour) NOT IN (SELECT instrument_id, t // 3600000000 FROM deriv WHERE funding_rate IS NULL) GROUP BY 1, 2""", "deriv"))
def append_derivatives(spark, sf_dir):
    d = ad.derivatives(spark, sf_dir).withColumn("hour", F.floor(micros("collected_at") / 3_600_000_000).cast("bigint"))
    stored = d.filter(F.col("funding_rate").isNull())
    return tb.only_new(d, stored, ["instrument_id", "hour"], F.col("id")).select("instrument_id", "hour", "id")


@query("k7_coverage_upsert", oracle("SELECT o_custkey AS run_id, o_orderpriority AS chain, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1, 2"))
def coverage_upsert(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("chain"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey"
    )
    return tb.latest_wins(o, ["run_id", "chain"], F.struct("o_orderdate", "o_orderkey")).select("run_id", "chain", "value")


@query("k7_duplicate_reports", oracle("SELECT o_custkey AS run_id, o_orderpriority AS source, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_reports(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("source"))
    return tb.duplicate_keys(o, ["run_id", "source"])


@query("k8_run_states", oracle("""SELECT user_id AS run_id, min(t) FILTER (event_type = 'view') AS started_us, max(t) FILTER (event_type <> 'view') AS finished_us, arg_max(CASE WHEN event_type = 'view' THEN 'running' ELSE event_type END, t) AS status FROM ev GROUP BY 1""", "ev"))
def run_states(spark, sf_dir):
    e = ad._events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("at")
    )
    return tb.run_states(e).select("run_id", micros("started_at").alias("started_us"), micros("finished_at").alias("finished_us"), "status")


@query("k1_snapshot_rows", oracle("SELECT id, CAST(CAST(make_timestamp(t) AS DATE) AS VARCHAR) AS dt, CASE WHEN id % 2 = 0 THEN '[\"A\",\"B\"]' ELSE '[\"B\"]' END AS momentum_sources_json FROM snap", "snap"))
def snapshot_rows(spark, sf_dir):
    s = ad.snapshots(spark, sf_dir).withColumn("momentum_sources", F.when(F.col("id") % 2 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("B"))))
    return tb.snapshot_row(s).select("id", F.col("dt").cast("string").alias("dt"), "momentum_sources_json")


@query("k10_score_backfill", oracle("""SELECT id AS snapshot_id, 'V1' AS score_version, coalesce(CASE WHEN effective_tier = 'HIDDEN' THEN NULL ELSE effective_tier END, 'NONE') AS effective_tier FROM snap WHERE price_usd IS NOT NULL AND id NOT IN (SELECT id FROM snap WHERE effective_tier = 'WATCH')""", "snap"))
def score_backfill(spark, sf_dir):
    s = ad.snapshots(spark, sf_dir).withColumns({
        "score": F.col("price_usd"), "tier": F.lit("NONE"), "score_version": F.lit("V1"), "raw_tier": F.lit(""),
        "effective_tier": F.when(F.col("effective_tier") == "HIDDEN", "").otherwise(F.col("effective_tier")),
    })
    stored = s.filter(F.col("effective_tier") == "WATCH").select(F.col("id").alias("snapshot_id"), "score_version")
    versions = s.select("score_version").distinct()
    return tb.backfill_scores(s, versions, stored).select("snapshot_id", "score_version", "effective_tier")


# ---- registry -----------------------------------------------------------------------------------


def configs(spark, sf_dir):
    """One config per supplier: valid, or broken in a way that follows from its key.

    The table is one small file and its configs are dear to read, so its keys are dealt to all cores.
    """
    keys = ad.table(spark, sf_dir, "supplier").select("s_suppkey").repartition(max(1, spark.sparkContext.defaultParallelism))
    good = json.dumps(sc.default_config("@V@"))
    k = F.col("s_suppkey")
    text = F.regexp_replace(F.lit(good), "@V@", F.when(k % 7 == 3, F.lit("bad version")).otherwise(F.concat(F.lit("S"), k)))
    text = F.when(k % 5 == 1, F.replace(text, F.lit('"breakout": 85.0'), F.lit('"breakout": 60.0'))).otherwise(text)
    text = F.when(k % 5 == 2, F.replace(text, F.lit('"under_30m": 10.0'), F.lit('"under_30m": -1.0'))).otherwise(text)
    text = F.when(k % 5 == 3, F.replace(text, F.lit('"clamp": {'), F.lit('"clamp": {"extra": 1, '))).otherwise(text)
    return keys.select(F.concat(F.lit("S"), k).alias("version"), text.alias("config_json"), k.alias("k"))


@query("r1_config_violations", oracle("""SELECT s_suppkey AS k, concat_ws(',', CASE WHEN s_suppkey % 5 = 3 THEN 'clamp_keys' END, CASE WHEN s_suppkey % 7 = 3 THEN 'version' END, CASE WHEN s_suppkey % 5 = 2 THEN 'age_bonus' END, CASE WHEN s_suppkey % 5 = 1 THEN 'tiers' END) AS violations FROM supplier"""))
def config_violations(spark, sf_dir):
    return configs(spark, sf_dir).select("k", F.array_join(rg.config_violations(F.col("config_json")), ",").alias("violations"))


@query("r2_identical_algorithms", oracle("SELECT 'S' || min(s_suppkey) AS first_version, count(*) AS versions FROM supplier GROUP BY CASE s_suppkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END"))
def identical_algorithms(spark, sf_dir):
    c = configs(spark, sf_dir).withColumn("n", F.col("k"))
    keyed = c.withColumn("algorithm", rg.algorithm_key(F.col("config_json")))
    return keyed.groupBy("algorithm").agg(F.concat(F.lit("S"), F.min("n")).alias("first_version"), F.countDistinct("version").alias("versions")).drop("algorithm")


define("rev", """SELECT event_id, t, 'V' || (user_id % 6) AS subject, CASE event_type WHEN 'purchase' THEN 'PROMOTE' WHEN 'error' THEN 'DISABLE' ELSE 'ENABLE' END AS et,
  CASE event_type WHEN 'purchase' THEN 'CHAMPION' WHEN 'error' THEN 'RETIRED' ELSE 'CHALLENGER' END AS to_role, CASE WHEN event_type = 'purchase' THEN 'V' || ((user_id + 1) % 6) END AS prev FROM ev""", "ev")
define("rch", "SELECT event_id, t, subject AS version, to_role AS role FROM rev UNION ALL SELECT event_id, t, prev, 'RETIRED' FROM rev WHERE prev IS NOT NULL", "rev")


def role_events(spark, sf_dir):
    e = ad._events(spark, sf_dir)
    kind, promote = F.col("event_type"), F.col("event_type") == "purchase"
    return e.select(
        "event_id", F.col("ts").alias("occurred_at"), F.concat(F.lit("V"), F.col("user_id") % 6).alias("subject_version"),
        F.when(promote, "PROMOTE").when(kind == "error", "DISABLE").otherwise("ENABLE").alias("event_type"),
        F.when(promote, "CHAMPION").when(kind == "error", "RETIRED").otherwise("CHALLENGER").alias("to_role"),
        F.when(promote, F.concat(F.lit("V"), (F.col("user_id") + 1) % 6)).alias("previous_champion_version"),
    )


@query("r3_current_roles", oracle("SELECT version, arg_max(role, (t, event_id)) AS role, max(t) AS changed_us FROM rch GROUP BY 1", "rch"))
def current_roles(spark, sf_dir):
    return rg.current_roles(role_events(spark, sf_dir)).select("version", "role", micros("changed_at").alias("changed_us"))


@query("r3_role_invariants", oracle("""SELECT count(*) FILTER (role = 'CHAMPION') AS champions, count(*) FILTER (role = 'CHALLENGER') AS challengers, count(*) FILTER (role = 'CHAMPION') = 1 AND count(*) FILTER (role = 'CHALLENGER') <= 3 AS valid
  FROM (SELECT version, arg_max(role, (t, event_id)) AS role FROM rch GROUP BY 1)""", "rch"))
def role_invariants(spark, sf_dir):
    return rg.role_invariants(rg.current_roles(role_events(spark, sf_dir)))


@query("r4_role_at_scoring", oracle("""SELECT s.id, s.version, coalesce(s.frozen, c.role) AS evaluation_role FROM (SELECT event_id AS id, t, 'V' || (k % 6) AS version, CASE WHEN k % 3 = 0 THEN 'CHAMPION' END AS frozen FROM ev) s
  ASOF LEFT JOIN (SELECT version, t, arg_max(role, event_id) AS role FROM rch GROUP BY 1, 2) c ON s.version = c.version AND s.t >= c.t""", "ev", "rch"))
def role_at_scoring(spark, sf_dir):
    s = ad._events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.concat(F.lit("V"), F.col("k") % 6).alias("score_version"),
        F.when(F.col("k") % 3 == 0, "CHAMPION").alias("evaluation_role"),
    )
    return rg.role_at(s, role_events(spark, sf_dir)).select("id", F.col("score_version").alias("version"), "evaluation_role")


@query("r5_version_conflicts", oracle("SELECT 'V' || (s_suppkey % 40) AS version, count(DISTINCT s_nationkey) AS configs FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1"))
def version_conflicts(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    reg = s.select(F.concat(F.lit("V"), F.col("s_suppkey") % 40).alias("version"), F.to_json(F.struct("s_nationkey")).alias("config_json"))
    return rg.version_conflicts(reg)
