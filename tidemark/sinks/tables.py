"""Row rules and writers of the stored tables.

Rules are DataFrame functions so they can be checked on their own; the writers at the end only
pick the mode and the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.scoring import MAX_CHALLENGERS
from tidemark.operators.study import report_order

FIRST_SEEN = ("first_seen_at", "first_seen_price_usd", "first_seen_market_cap_usd", "first_seen_score")
MUTABLE = ("name", "symbol", "pair_address", "address")


def upsert_tokens(stored: DataFrame, incoming: DataFrame, seen: str = "seen_at") -> DataFrame:
    """Keep everything first seen, overwrite only name, symbol, pair and address with the newest row."""
    rows = stored.unionByName(incoming, allowMissingColumns=True)
    first = [c for c in FIRST_SEEN if c in rows.columns]
    latest = [c for c in MUTABLE if c in rows.columns]
    return rows.groupBy("token_id").agg(
        F.min_by(F.struct(*first), F.col(seen)).alias("f"), F.max_by(F.struct(*latest), F.col(seen)).alias("m"),
        F.max(seen).alias(seen),
    ).select("token_id", "f.*", "m.*", seen)


def score_set_problems(scores: DataFrame) -> DataFrame:
    """Snapshots whose version scores break a rule, with the rule."""
    role = F.col("evaluation_role")
    per_version = scores.groupBy("snapshot_id", "score_version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(role == "CHAMPION").alias("champ"), F.count_if(role == "CHALLENGER").alias("chal"),
        F.count_if(F.coalesce(F.col("score_version"), F.lit("")) == "").alias("unnamed"),
        F.count_if(~F.coalesce(F.col("breakdown_version") == F.col("score_version"), F.lit(False))).alias("mismatch"),
        F.count_if(~F.coalesce(role.isin("CHAMPION", "CHALLENGER"), F.lit(False))).alias("bad_role"),
    )
    per = per_version.groupBy("snapshot_id").agg(
        F.max("n").alias("copies"), *[F.sum(c).alias(c) for c in ("champ", "chal", "unnamed", "mismatch", "bad_role")]
    )
    problem = (
        F.when(F.col("unnamed") > 0, "missing_version").when(F.col("copies") > 1, "duplicate_version")
        .when(F.col("mismatch") > 0, "breakdown_version").when(F.col("bad_role") > 0, "invalid_role")
        .when(F.col("champ") != 1, "champion_count").when(F.col("chal") > MAX_CHALLENGERS, "too_many_challengers")
    )
    return per.select("snapshot_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def valid_scores(scores: DataFrame) -> DataFrame:
    """Scores of the snapshots without a problem; a broken snapshot is refused as a whole."""
    return scores.join(score_set_problems(scores), "snapshot_id", "left_anti")


def project_champion(snapshots: DataFrame, scores: DataFrame) -> DataFrame:
    """Copy the champion's score, tier and version onto the snapshot row."""
    champion = scores.filter(F.col("evaluation_role") == "CHAMPION").select(
        "snapshot_id", F.col("raw_score").alias("__s"), F.col("effective_tier").alias("__t"), F.col("score_version").alias("__v")
    )
    joined = snapshots.join(champion, snapshots["id"] == champion["snapshot_id"], "inner").drop("snapshot_id")
    out = joined.withColumns({"score": F.col("__s"), "tier": F.col("__t"), "score_version": F.col("__v")})
    if "data_quality" in snapshots.columns:
        fresh = F.create_map(F.lit("score"), F.lit("fresh"))
        kept = F.map_filter("data_quality", lambda k, v: k != "score")
        out = out.withColumn("data_quality", F.map_concat(kept, fresh))
    return out.drop("__s", "__t", "__v")


def publishable(opportunities: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, refused rows): only finished completed or degraded runs carry rows."""
    ok = runs.filter(F.col("status").isin("completed", "degraded") & F.col("finished_at").isNotNull()).select("run_id")
    return opportunities.join(ok, "run_id", "left_semi"), opportunities.join(ok, "run_id", "left_anti")


def only_new(rows: DataFrame, stored: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First row per key among the incoming ones, without keys that are already stored."""
    keys = list(keys)
    cols = F.struct(*[c for c in rows.columns if c not in keys])
    fresh = rows.groupBy(*keys).agg(F.min_by(cols, order).alias("r")).select(*keys, "r.*")
    return fresh.join(stored.select(*keys).distinct(), keys, "left_anti")


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    keys = list(keys)
    cols = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(cols, order).alias("r")).select(*keys, "r.*")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def run_states(events: DataFrame) -> DataFrame:
    """Start and current status of each run from its append-only start and finish events."""
    return events.groupBy("run_id").agg(
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"),
        F.max_by("status", F.struct("at", F.col("status") != "running")).alias("status"),
    )


def backfill_scores(snapshots: DataFrame, versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Champion score rows for scored snapshots of a registered version that have none yet."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = snapshots.filter(F.col("score").isNotNull()).join(versions.select("score_version").distinct(), "score_version", "left_semi")
    out = rows.select(
        F.col("id").alias("snapshot_id"), "score_version", F.lit("CHAMPION").alias("evaluation_role"),
        F.coalesce("raw_score", "score").alias("raw_score"), F.coalesce(blank("raw_tier"), F.col("tier")).alias("raw_tier"),
        F.coalesce(blank("effective_tier"), F.col("tier")).alias("effective_tier"), F.col("collected_at").alias("created_at"),
    )
    return out.join(stored.select("snapshot_id", "score_version"), ["snapshot_id", "score_version"], "left_anti")


def snapshot_row(snapshots: DataFrame) -> DataFrame:
    """Stored form: sorted sources, nested parts as JSON, a date partition column."""
    out = snapshots.withColumn("dt", F.to_date("collected_at"))
    if "momentum_sources" in out.columns:
        out = out.withColumn("momentum_sources", F.array_sort("momentum_sources"))
    for name in ("risk_flags", "data_quality", "momentum_sources", "factors"):
        if name in out.columns:
            out = out.withColumn(f"{name}_json", F.to_json(name)).drop(name)
    return out


# ---- writers ------------------------------------------------------------------------------------


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append by date. Adaptive execution splits large days and joins small ones, so files follow volume, not days."""
    snapshot_row(snapshots).hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def publish_runs(opportunities: DataFrame, runs: DataFrame, path: str, generation: int) -> None:
    """Replace the rows of each published run as a whole, also by none.

    Rows are written under a generation of their own; the list of the runs it publishes comes last and
    makes it visible. Writing a generation twice is refused.
    """
    rows, _ = publishable(opportunities, runs)
    rows.write.mode("errorifexists").parquet(f"{path}/rows/generation={generation}")
    ok = runs.filter(F.col("status").isin("completed", "degraded") & F.col("finished_at").isNotNull())
    ok.select("run_id").distinct().write.mode("errorifexists").parquet(f"{path}/runs/generation={generation}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest generation of every run."""
    runs = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs")
    newest = runs.groupBy("run_id").agg(F.max("generation").alias("generation"))
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(newest, ["run_id", "generation"]).drop("generation")


def write_report_json(statistics: DataFrame, path: str) -> None:
    statistics.orderBy(*report_order()).write.mode("overwrite").json(path)


def write_report_text(lines: DataFrame, path: str) -> None:
    """Text rows, one folder per section."""
    lines.select("section", F.col("line").alias("value")).write.mode("overwrite").partitionBy("section").text(path)
