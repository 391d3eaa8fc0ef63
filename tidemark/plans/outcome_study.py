"""Signal outcome study over whole snapshot histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timecol import HOUR
from tidemark.operators import study as st
from tidemark.session import staged


def outcomes(
    snapshots: DataFrame,
    scores: DataFrame,
    activation_id: Column | int,
    thresholds: Sequence[int] = st.THRESHOLDS,
    horizons: Sequence[st.Horizon] = st.HORIZONS,
    bucket: int = HOUR,
) -> DataFrame:
    """Signals, entries and evaluated horizon outcomes up to the newest snapshot.

    Entries are at most one per token, version and threshold. They are staged so that the scores,
    the largest input, are read once although entries feed both sides of the evaluation.
    """
    edge = st.frontier(snapshots)
    high = edge.select("high_watermark").scalar()
    seen = edge.select("observed_at").scalar()
    entries = staged(st.paper_entries(st.first_crossings(scores, activation_id, thresholds)), "paper-entries")
    observed = st.observe_horizons(entries, st.price_observations(snapshots, high), horizons, bucket)
    return st.evaluate_outcomes(st.expand_horizons(entries, horizons), observed, high, seen)


def statistics(
    evaluated: DataFrame,
    watermark: Column,
    thresholds: Sequence[int] = st.THRESHOLDS,
    horizons: Sequence[st.Horizon] = st.HORIZONS,
) -> DataFrame:
    """Dense threshold statistics of the study as it stood at a watermark.

    The outcome rows feed the counts, the medians and the version list, so they are staged once.
    """
    evaluated = staged(evaluated, "study-outcomes")
    visible = st.project_to_watermark(evaluated, watermark)
    return st.threshold_statistics(visible, st.score_versions(evaluated, watermark), thresholds, horizons)


def materialize(statistic_rows: DataFrame, run_id: int, path: str) -> None:
    """Append one immutable analysis run as its own partition."""
    try:
        statistic_rows.write.mode("errorifexists").parquet(f"{path}/analysis_run_id={run_id}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError(f"analysis run {run_id} already exists and is immutable") from e


def latest_analysis(stored: DataFrame) -> DataFrame:
    """Rows of the newest stored run in report order."""
    newest = stored.agg(F.max("analysis_run_id").alias("newest")).select("newest").scalar()
    return stored.filter(F.col("analysis_run_id") == newest).orderBy(*st.report_order())
