"""Queries of the signal outcome study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import HOUR, micros
from tidemark.operators import study as st
from tidemark.operators.joins import asof_backward, first_in_lookback
from tidemark.operators.order_stats import grouped_median
from tidemark.operators.pyramid import range_summaries
from tidemark.plans import outcome_study as plan
from tidemark.session import shared_dir, staged
from tidemark.sources import adapters as ad

HZ = (st.Horizon("6h", 6 * HOUR, 6 * HOUR), st.Horizon("24h", 24 * HOUR, 12 * HOUR), st.Horizon("72h", 72 * HOUR, 24 * HOUR))

define("edge", "SELECT max(id) AS hw, max(t) AS seen, max(id) // 2 AS act FROM snap", "snap")
define("th", "SELECT unnest([55, 60, 65, 70, 75, 80, 85, 90]) AS threshold")
define("hz", "SELECT * FROM (VALUES ('6h', 21600000000, 21600000000), ('24h', 86400000000, 43200000000), ('72h', 259200000000, 86400000000)) h(horizon, off, tol)")
define("sig", """SELECT token_id, score_version, threshold, chain, CASE WHEN id > (SELECT act FROM edge) THEN 'LIVE' ELSE 'BACKFILL' END AS signal_source,
  id AS sid, t AS st, price_usd, raw_score, evidence_confidence, CASE WHEN price_usd > 0 THEN price_usd END AS entry,
  CASE WHEN price_usd > 0 THEN 'EVALUABLE' ELSE 'UNAVAILABLE_PRICE' END AS entry_status
  FROM scores CROSS JOIN th WHERE raw_score >= threshold
  QUALIFY row_number() OVER (PARTITION BY token_id, score_version, threshold ORDER BY id) = 1""", "scores", "edge", "th")
define("outc0", "SELECT sig.*, horizon, st + off AS target, st + off + tol AS wend FROM sig CROSS JOIN hz", "sig", "hz")
define("sel", """SELECT o.token_id, o.score_version, o.threshold, o.horizon, s.id AS xid, s.t AS xt, s.price_usd AS xp
  FROM outc0 o JOIN snap s ON s.token_id = o.token_id AND s.id > o.sid AND s.t > o.st AND s.t BETWEEN o.target AND o.wend AND s.price_usd > 0
  WHERE o.entry IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o.token_id, o.score_version, o.threshold, o.horizon ORDER BY s.t, s.id) = 1""", "outc0")
define("path", """SELECT o.token_id, o.score_version, o.threshold, o.horizon, greatest(0, max(s.price_usd / o.entry - 1)) AS mfe, least(0, min(s.price_usd / o.entry - 1)) AS mae,
  count(*) AS points FROM outc0 o JOIN sel USING (token_id, score_version, threshold, horizon)
  JOIN snap s ON s.token_id = o.token_id AND s.id > o.sid AND s.t > o.st AND s.t <= xt AND s.price_usd > 0 GROUP BY 1, 2, 3, 4""", "outc0", "sel")
define("outc", """SELECT o.*, xid, xt, CASE WHEN o.entry IS NULL THEN 'NOT_EVALUABLE' WHEN xid IS NOT NULL THEN 'MATURED'
    WHEN (SELECT seen FROM edge) > wend THEN 'INSUFFICIENT_DATA' ELSE 'PENDING' END AS status,
    xp / entry - 1 AS ret, mfe, mae, CAST((xt - target) // 1000000 AS BIGINT) AS delay
  FROM outc0 o LEFT JOIN sel USING (token_id, score_version, threshold, horizon) LEFT JOIN path USING (token_id, score_version, threshold, horizon)""",
  "outc0", "sel", "path", "edge")
define("proj", """SELECT * EXCLUDE (status, ret, mfe, mae), CASE WHEN late THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT late THEN ret END AS ret,
  CASE WHEN NOT late THEN mfe END AS mfe, CASE WHEN NOT late THEN mae END AS mae
  FROM (SELECT *, coalesce(xid > (SELECT hw * 4 // 5 FROM edge), false) AS late FROM outc WHERE sid <= (SELECT hw * 4 // 5 FROM edge))""", "outc")


def STATS(src):
    return f"""SELECT src AS signal_source_scope, ch AS chain_scope, evs AS evidence_scope, v.score_version, th.threshold, hz.horizon,
  count(o.token_id) AS signals, count(*) FILTER (o.entry_status = 'EVALUABLE') AS evaluable,
  count(*) FILTER (o.entry_status = 'EVALUABLE' AND o.status = 'PENDING') AS pending,
  count(*) FILTER (o.status = 'MATURED') AS matured, count(*) FILTER (o.status = 'INSUFFICIENT_DATA') AS insufficient,
  count(*) FILTER (o.status = 'MATURED' AND o.ret > 0) AS positive,
  quantile_cont(o.ret, 0.5) FILTER (o.status = 'MATURED') AS mret, quantile_cont(o.mfe, 0.5) FILTER (o.status = 'MATURED') AS mmfe,
  quantile_cont(o.mae, 0.5) FILTER (o.status = 'MATURED') AS mmae
  FROM (SELECT unnest(['BACKFILL','LIVE','ALL']) AS src) CROSS JOIN (SELECT unnest(['BSC','SOLANA','ALL']) AS ch)
  CROSS JOIN (SELECT unnest(['HIGH_GOOD','MEDIUM_LOW','UNKNOWN','ALL']) AS evs) CROSS JOIN (SELECT DISTINCT score_version FROM {src}) v CROSS JOIN th CROSS JOIN hz
  LEFT JOIN (SELECT *, CASE WHEN evidence_confidence IN ('HIGH','GOOD') THEN 'HIGH_GOOD' WHEN evidence_confidence IN ('MEDIUM','LOW') THEN 'MEDIUM_LOW' ELSE 'UNKNOWN' END AS es FROM {src}) o
    ON o.score_version = v.score_version AND o.threshold = th.threshold AND o.horizon = hz.horizon
    AND (src = 'ALL' OR src = o.signal_source) AND (ch = 'ALL' OR ch = upper(o.chain)) AND (evs = 'ALL' OR evs = o.es)
  GROUP BY ALL"""


define("stats", STATS("outc"), "outc", "th", "hz")
define("pstats", STATS("proj"), "proj", "th", "hz")
STAT_COLS = """signal_source_scope, chain_scope, evidence_scope, score_version, CAST(threshold AS BIGINT) AS threshold, horizon, signals, evaluable, signals - evaluable AS not_evaluable,
  round(CASE WHEN signals <> 0 THEN evaluable / signals END, 8) AS entry_price_coverage, pending, matured, insufficient,
  round(CASE WHEN evaluable <> 0 THEN (matured + insufficient) / evaluable END, 8) AS maturity_coverage,
  round(CASE WHEN matured + insufficient <> 0 THEN matured / (matured + insufficient) END, 8) AS result_coverage,
  round(CASE WHEN matured <> 0 THEN positive / matured END, 8) AS positive_return_rate,
  round(mret, 8) AS median_return, round(mmfe, 8) AS median_mfe, round(mmae, 8) AS median_mae, matured < 20 AS insufficient_sample"""


def activation(snaps):
    return F.floor(snaps.agg(F.max("id").alias("m")).select("m").scalar() / 2)


def entries(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    return st.paper_entries(st.first_crossings(ad.scores_from(snaps), activation(snaps)))


def outcomes(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    return plan.outcomes(snaps, ad.scores_from(snaps), activation(snaps), horizons=HZ, bucket=12 * HOUR)


def _edge(spark, sf_dir, column="high_watermark"):
    return st.frontier(ad.snapshots(spark, sf_dir)).select(column).scalar()


def statistics(spark, sf_dir):
    return plan.statistics(outcomes(spark, sf_dir), _edge(spark, sf_dir), horizons=HZ)


def rounded_stats(df):
    out = df
    for c in ("entry_price_coverage", "maturity_coverage", "result_coverage", "positive_return_rate", "median_return", "median_mfe", "median_mae"):
        out = out.withColumn(c, F.round(c, 8) + F.lit(0.0))
    return out


KEY = list(st.SIGNAL_KEY)
KEY_SQL = "token_id, score_version, CAST(threshold AS BIGINT) AS threshold"


@query("a15_source_frontier", oracle("SELECT hw AS high_watermark, seen AS observed_us FROM edge", "edge"))
def source_frontier(spark, sf_dir):
    return st.frontier(ad.snapshots(spark, sf_dir)).select("high_watermark", micros("observed_at").alias("observed_us"))


@query("w21_first_crossings", oracle(f"SELECT {KEY_SQL}, sid AS signal_snapshot_id, st AS signal_us, raw_score FROM sig", "sig"))
def first_crossings(spark, sf_dir):
    return entries(spark, sf_dir).select(*KEY, "signal_snapshot_id", micros("signal_at").alias("signal_us"), "raw_score")


@query("l1_signal_generation", oracle("SELECT signal_source, chain, score_version, CAST(threshold AS BIGINT) AS threshold, count(*) AS signals FROM sig GROUP BY ALL", "sig"))
def signal_generation(spark, sf_dir):
    return entries(spark, sf_dir).groupBy(
        "signal_source", "chain", "score_version", "threshold"
    ).agg(F.count(F.lit(1)).alias("signals"))


@query("l2_paper_entries", oracle(f"SELECT {KEY_SQL}, entry_status, entry AS entry_price_usd FROM sig", "sig"))
def paper_entries(spark, sf_dir):
    return entries(spark, sf_dir).select(*KEY, "entry_status", "entry_price_usd")


@query("l3_horizon_expansion", oracle(f"SELECT {KEY_SQL}, horizon, target AS target_us, wend AS window_end_us, CASE WHEN entry IS NULL THEN 'NOT_EVALUABLE' ELSE 'PENDING' END AS status FROM outc0", "outc0"))
def horizon_expansion(spark, sf_dir):
    return st.expand_horizons(entries(spark, sf_dir), HZ).select(
        *KEY, "horizon", micros("target_at").alias("target_us"), micros("window_end_at").alias("window_end_us"), "status"
    )


@query("j4_outcome_selection", oracle(f"SELECT {KEY_SQL}, horizon, xid AS selected_snapshot_id, xt AS selected_us FROM sel", "sel"))
def outcome_selection(spark, sf_dir):
    return outcomes(spark, sf_dir).filter(F.col("status") == "MATURED").select(
        *KEY, "horizon", "selected_snapshot_id", micros("selected_at").alias("selected_us")
    )


@query("j5_price_path", oracle("""SELECT token_id, score_version, CAST(threshold AS BIGINT) AS threshold, horizon, points FROM path""", "path"))
def price_path(spark, sf_dir):
    """Number of observations on each matured path."""
    return _paths(spark, sf_dir).select(*KEY, "horizon", F.col("n").alias("points"))


def _paths(spark, sf_dir):
    """Matured outcomes with what their price path sums up to; thresholds and versions that share a path ask for it once."""
    matured = outcomes(spark, sf_dir).filter(F.col("status") == "MATURED").select(
        *st.SIGNAL_KEY, "horizon", "signal_snapshot_id", "signal_at", "selected_at", "entry_price_usd"
    )
    matured = staged(matured, "matured")
    prices = st.price_observations(ad.snapshots(spark, sf_dir), _edge(spark, sf_dir))
    path = ["token_id", "signal_at", "selected_at", "signal_snapshot_id"]
    found = range_summaries(
        matured.select(*path).distinct(), prices, ["token_id"], "signal_at", "selected_at", "signal_snapshot_id", "obs_at", "obs_price", "obs_id", HOUR
    )
    return matured.join(found, path)


@query("a11_excursions", oracle(f"SELECT {KEY_SQL}, horizon, round(mfe, 8) AS mfe, round(mae, 8) AS mae FROM path", "path"))
def excursions(spark, sf_dir):
    change = lambda c: F.col(c) / F.col("entry_price_usd") - 1
    return _paths(spark, sf_dir).select(
        *KEY, "horizon", (F.round(F.greatest(F.lit(0.0), change("greatest")), 8) + 0.0).alias("mfe"), (F.round(F.least(F.lit(0.0), change("least")), 8) + 0.0).alias("mae")
    )


@query("a11_study_excursions", oracle(f"SELECT {KEY_SQL}, horizon, round(mfe, 8) AS mfe, round(mae, 8) AS mae FROM path", "path"))
def study_excursions(spark, sf_dir):
    """The same from the study's own range join, where the selected price is found as well."""
    return outcomes(spark, sf_dir).filter(F.col("status") == "MATURED").select(
        *KEY, "horizon", (F.round("mfe_decimal", 8) + 0.0).alias("mfe"), (F.round("mae_decimal", 8) + 0.0).alias("mae")
    )


@query("l4_outcomes", oracle(f"SELECT {KEY_SQL}, horizon, status, round(ret, 8) AS return_decimal FROM outc", "outc"))
def outcome_rows(spark, sf_dir):
    return outcomes(spark, sf_dir).select(*KEY, "horizon", "status", (F.round("return_decimal", 8) + 0.0).alias("return_decimal"))


@query("l5_selection_delay", oracle("SELECT horizon, count(delay) AS matured, CAST(sum(delay) AS BIGINT) AS total_delay_seconds, max(delay) AS longest FROM outc GROUP BY 1", "outc"))
def selection_delay(spark, sf_dir):
    d = F.col("selection_delay_seconds")
    return outcomes(spark, sf_dir).groupBy("horizon").agg(
        F.count(d).alias("matured"), F.sum(d).alias("total_delay_seconds"), F.max(d).alias("longest")
    )


@query("l6_watermark_projection", oracle("SELECT status, horizon, count(*) AS outcomes, count(ret) AS with_return FROM proj GROUP BY ALL", "proj"))
def watermark_projection(spark, sf_dir):
    cut = F.floor(_edge(spark, sf_dir) * 4 / 5)
    seen = outcomes(spark, sf_dir).withColumn("evaluation_watermark", F.col("selected_snapshot_id"))
    return st.project_to_watermark(seen, cut).groupBy("status", "horizon").agg(
        F.count(F.lit(1)).alias("outcomes"), F.count("return_decimal").alias("with_return")
    )


@query("a12_threshold_statistics", oracle(f"SELECT {STAT_COLS} FROM stats", "stats"))
def threshold_statistics(spark, sf_dir):
    return rounded_stats(statistics(spark, sf_dir))


@query("l7_statistics_at_watermark", oracle(f"SELECT {STAT_COLS} FROM pstats", "pstats"))
def statistics_at_watermark(spark, sf_dir):
    cut = F.floor(_edge(spark, sf_dir) * 4 / 5)
    seen = outcomes(spark, sf_dir).withColumn("evaluation_watermark", F.col("selected_snapshot_id"))
    return rounded_stats(plan.statistics(seen, cut, horizons=HZ))


@query("a16_score_versions", oracle("SELECT DISTINCT score_version FROM sig WHERE sid <= (SELECT hw FROM edge)", "sig", "edge"))
def score_versions(spark, sf_dir):
    return st.score_versions(entries(spark, sf_dir), _edge(spark, sf_dir))


@query("a9_exact_median", oracle("SELECT event_type, quantile_cont(value, 0.5) AS median_value FROM events GROUP BY 1"))
def exact_median(spark, sf_dir):
    return grouped_median(ad.table(spark, sf_dir, "events"), ["event_type"], "value", "median_value")


@query("l9_integrity_audit", oracle("""SELECT CAST(0 AS BIGINT) AS duplicate_keys,
  count(*) FILTER (status = 'MATURED' AND (xt <= st OR xid <= sid)) AS selected_not_later,
  count(*) FILTER (status = 'MATURED' AND (xt < target OR xt > wend)) AS selected_outside_window,
  count(*) FILTER (status = 'MATURED' AND xid > (SELECT hw FROM edge)) AS selected_above_watermark,
  count(*) FILTER (status = 'MATURED' AND ret IS NULL) AS matured_without_metrics,
  count(*) FILTER (status <> 'MATURED' AND ret IS NOT NULL) AS metrics_without_maturity,
  count(*) FILTER (status = 'MATURED' AND (mfe < 0 OR mae > 0)) AS excursion_sign,
  count(*) FILTER (entry_status = 'EVALUABLE' AND entry IS NULL) AS entry_price_mismatch FROM outc""", "outc"))
def integrity_audit(spark, sf_dir):
    return st.integrity_audit(outcomes(spark, sf_dir), _edge(spark, sf_dir))


# One rule is broken at each threshold, so every count of the audit has rows to find.
@query("l9_planted_violations", oracle("""SELECT CAST((SELECT count(*) FROM outc WHERE threshold = 85) AS BIGINT) AS duplicate_keys,
  count(*) FILTER (status = 'MATURED' AND (xt <= st OR xid <= sid)) AS selected_not_later,
  count(*) FILTER (status = 'MATURED' AND (xt < target OR xt > wend)) AS selected_outside_window,
  count(*) FILTER (status = 'MATURED' AND xid > (SELECT hw FROM edge)) AS selected_above_watermark,
  count(*) FILTER (status = 'MATURED' AND ret IS NULL) AS matured_without_metrics,
  count(*) FILTER (status <> 'MATURED' AND (ret IS NOT NULL OR mfe IS NOT NULL)) AS metrics_without_maturity,
  count(*) FILTER (status = 'MATURED' AND (mfe < 0 OR mae > 0)) AS excursion_sign,
  count(*) FILTER (entry_status = 'EVALUABLE' AND entry IS NULL) AS entry_price_mismatch
  FROM (SELECT * REPLACE (CASE WHEN threshold = 55 AND xt IS NOT NULL THEN st ELSE xt END AS xt, CASE WHEN threshold = 60 AND xid IS NOT NULL THEN 4611686018427387904 ELSE xid END AS xid,
    CASE WHEN threshold <> 65 THEN ret END AS ret, CASE WHEN threshold = 70 AND status <> 'MATURED' THEN 1 WHEN threshold = 75 AND status = 'MATURED' THEN -1 ELSE mfe END AS mfe,
    CASE WHEN threshold <> 80 THEN entry END AS entry) FROM outc)""", "outc"))
def planted_violations(spark, sf_dir):
    at, matured = F.col("threshold"), F.col("status") == "MATURED"
    whole = outcomes(spark, sf_dir)
    planted = whole.withColumns({
        "selected_at": F.when((at == 55) & matured, F.col("signal_at")).otherwise(F.col("selected_at")),
        "selected_snapshot_id": F.when((at == 60) & matured, F.lit(2**62)).otherwise(F.col("selected_snapshot_id")),
        "return_decimal": F.when(at != 65, F.col("return_decimal")),
        "mfe_decimal": F.when((at == 70) & ~matured, 1.0).when((at == 75) & matured, -1.0).otherwise(F.col("mfe_decimal")),
        "entry_price_usd": F.when(at != 80, F.col("entry_price_usd")),
    })
    return st.integrity_audit(planted.unionByName(planted.filter(at == 85)), _edge(spark, sf_dir))


@query("j14_study_join", oracle("""SELECT s.score_version, s.entry_status, o.status, count(*) AS outcomes FROM sig s JOIN outc o USING (token_id, score_version, threshold) GROUP BY ALL""", "sig", "outc"))
def study_join(spark, sf_dir):
    signals = entries(spark, sf_dir).select(*st.SIGNAL_KEY, "entry_status")
    rows = outcomes(spark, sf_dir).select(*st.SIGNAL_KEY, "horizon", "status")
    return signals.join(rows, list(st.SIGNAL_KEY)).groupBy("score_version", "entry_status", "status").agg(
        F.count(F.lit(1)).alias("outcomes")
    )


@query("j15_pending_worklist", oracle(f"SELECT {KEY_SQL}, horizon, target AS target_us, entry AS entry_price_usd FROM proj WHERE status = 'PENDING' AND entry_status = 'EVALUABLE'", "proj"))
def pending_worklist(spark, sf_dir):
    pending = (F.col("status") == "PENDING") & (F.col("entry_status") == "EVALUABLE")
    cut = F.floor(_edge(spark, sf_dir) * 4 / 5)
    seen = outcomes(spark, sf_dir).withColumn("evaluation_watermark", F.col("selected_snapshot_id"))
    return st.project_to_watermark(seen, cut).filter(pending).select(*KEY, "horizon", micros("target_at").alias("target_us"), "entry_price_usd")


_CMP = """SELECT a.signal_source_scope, a.chain_scope, a.evidence_scope, a.score_version, CAST(a.threshold AS BIGINT) AS threshold, a.horizon, a.signals, a.matured,
  CASE WHEN a.score_version <> 'V1' THEN round(a.mret - c.mret, 8) END AS delta_median_return,
  CASE WHEN a.score_version <> 'V1' THEN round(CASE WHEN a.matured <> 0 THEN a.positive / a.matured END - CASE WHEN c.matured <> 0 THEN c.positive / c.matured END, 8) END AS delta_positive_return_rate,
  CASE WHEN a.matured < 20 THEN 'INSUFFICIENT' ELSE 'OK' END AS sample
  FROM stats a LEFT JOIN (SELECT * FROM stats WHERE score_version = 'V1') c USING (signal_source_scope, chain_scope, evidence_scope, threshold, horizon)"""


def compared(spark, sf_dir, versions=None):
    rows = st.compare_versions(statistics(spark, sf_dir), "V1", versions)
    return rows.select(
        "signal_source_scope", "chain_scope", "evidence_scope", "score_version", "threshold", "horizon",
        "signals", "matured", (F.round("delta_median_return", 8) + 0.0).alias("delta_median_return"),
        (F.round("delta_positive_return_rate", 8) + 0.0).alias("delta_positive_return_rate"), "sample",
    )


@query("j12_champion_comparison", oracle(_CMP, "stats"))
def champion_comparison(spark, sf_dir):
    return compared(spark, sf_dir)


@query("c28_comparison_report", oracle(f"SELECT * FROM ({_CMP}) WHERE score_version = 'V2'", "stats"))
def comparison_report(spark, sf_dir):
    return compared(spark, sf_dir, ["V1", "V2"]).filter(F.col("score_version") == "V2")


@query("o9_report_order", oracle("""SELECT row_number() OVER (ORDER BY CASE signal_source_scope WHEN 'BACKFILL' THEN 1 WHEN 'LIVE' THEN 2 ELSE 3 END,
  chain_scope, evidence_scope, score_version, threshold, horizon) AS position, signal_source_scope, chain_scope, evidence_scope, score_version, CAST(threshold AS BIGINT) AS threshold, horizon, signals FROM stats""", "stats"))
def report_order(spark, sf_dir):
    """Position of each cell in the report; the grid is bounded by scopes x versions x thresholds x horizons."""
    from pyspark.sql import Window

    rows = statistics(spark, sf_dir)
    return rows.select(
        F.row_number().over(Window.orderBy(*st.report_order())).cast("bigint").alias("position"), "signal_source_scope", "chain_scope",
        "evidence_scope", "score_version", "threshold", "horizon", "signals",
    )


def _pct(x):
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE printf('%.2f%%', {x} * 100) END"


@query("k9_report_lines", oracle(f"""SELECT signal_source_scope AS section, chain_scope || '/' || evidence_scope || ' v=' || score_version || ' score>=' || threshold || ' horizon=' || horizon
  || ' signals=' || signals || ' evaluable=' || evaluable || ' entry=' || {_pct('CASE WHEN signals <> 0 THEN evaluable / signals END')} || ' matured=' || matured AS line FROM stats""", "stats"))
def report_lines(spark, sf_dir):
    lines = st.report_lines(statistics(spark, sf_dir))
    return lines.select("section", F.substring_index("line", " result=", 1).alias("line"))


@query("j3_asof_inclusive", oracle("""SELECT a.id, b.id AS baseline_id, b.price_usd AS baseline_price FROM (SELECT *, t - 21600000000 AS cut FROM deriv) a
  ASOF LEFT JOIN deriv b ON a.asset_class = b.asset_class AND a.instrument_id = b.instrument_id AND a.cut >= b.t""", "deriv"))
def asof_inclusive(spark, sf_dir):
    d = ad.derivatives(spark, sf_dir)
    left = d.withColumn("cut", F.timestamp_micros(micros("collected_at") - 6 * HOUR))
    out = asof_backward(left, d, ["asset_class", "instrument_id"], "cut", "collected_at", ["id", "price_usd"], "id")
    return out.select("id", F.col("asof.id").alias("baseline_id"), F.col("asof.price_usd").alias("baseline_price"))


@query("j3_asof_strict", oracle("""SELECT a.id, b.id AS baseline_id FROM deriv a ASOF LEFT JOIN deriv b
  ON a.asset_class = b.asset_class AND a.instrument_id = b.instrument_id AND a.t > b.t""", "deriv"))
def asof_strict(spark, sf_dir):
    d = ad.derivatives(spark, sf_dir)
    out = asof_backward(d, d, ["asset_class", "instrument_id"], "collected_at", "collected_at", ["id"], "id", strict=True)
    return out.select("id", F.col("asof.id").alias("baseline_id"))


@query("j8_earliest_in_lookback", oracle("""SELECT a.id, arg_min(b.id, (b.t, b.id)) AS earlier_id, count(b.id) > 0 AS found FROM snap a LEFT JOIN snap b
  ON a.token_id = b.token_id AND b.t < a.t AND b.t >= a.t - 21600000000 GROUP BY 1""", "snap"))
def earliest_in_lookback(spark, sf_dir):
    out = first_in_lookback(ad.snapshots(spark, sf_dir), ["token_id"], "collected_at", "id", ["id"], 6 * HOUR, 12 * HOUR)
    return out.select("id", F.col("earlier.id").alias("earlier_id"), F.col("earlier").isNotNull().alias("found"))


@query("u4_new_signals_only", oracle("""SELECT token_id, score_version, CAST(threshold AS BIGINT) AS threshold FROM sig EXCEPT SELECT token_id, score_version, CAST(threshold AS BIGINT) FROM sig WHERE signal_source = 'BACKFILL'""", "sig"))
def new_signals_only(spark, sf_dir):
    found = entries(spark, sf_dir)
    return st.new_signals(found, found.filter(F.col("signal_source") == "BACKFILL")).select(*KEY)


@query("j9_scored_star_join", oracle("SELECT s.id, x.score_version, x.role FROM snap s LEFT JOIN scores x ON x.id = s.id AND x.raw_score >= 50", "snap", "scores"))
def scored_star_join(spark, sf_dir):
    snaps = ad.snapshots(spark, sf_dir)
    scores = ad.scores_from(snaps).filter(F.col("raw_score") >= 50).select("id", "score_version", "role")
    return snaps.select("id").join(scores, "id", "left")


@query("l8_latest_analysis", oracle(f"SELECT {STAT_COLS} FROM stats", "stats"))
def latest_analysis(spark, sf_dir):
    """Two stored runs, an earlier one at a lower watermark; the newest is read back."""
    path = shared_dir(spark, "analyses")
    evaluated = staged(outcomes(spark, sf_dir).withColumn("evaluation_watermark", F.col("selected_snapshot_id")), "evaluated")
    top = _edge(spark, sf_dir)
    plan.materialize(plan.statistics(evaluated, F.floor(top * 4 / 5), horizons=HZ), 1, path)
    plan.materialize(plan.statistics(evaluated, top, horizons=HZ), 2, path)
    stored = spark.read.parquet(path)
    return rounded_stats(plan.latest_analysis(stored)).drop("analysis_run_id")
