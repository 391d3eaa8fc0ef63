"""Times the headline queries and prints one JSON line.

Each query first runs once on the smallest tables, so that the measured run shows data work
rather than class loading and first-time code generation; measured results are fully computed
and discarded by the no-op writer.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import REGISTRY
from tidemark.session import build_session

HEADLINE = (
    "a1_trade_window_stats", "c8_multi_version_scores", "c8_four_versions", "c11_candidate_merge", "o7_bounded_universe",
    "j3_asof_inclusive", "j8_earliest_in_lookback", "w21_first_crossings", "l4_outcomes", "a12_threshold_statistics",
    "w25_resampled_bars", "w4_macd", "w10_false_breakouts", "c13_start_score", "c25_price_plan", "c21_liquid_universe",
    "w22_episodes", "o6_leaderboard_by_rate", "p28_token_views", "s1_new_pools", "t5_tumbling_windows",
)
ROWS = {"c8_multi_version_scores": "events", "c8_four_versions": "events", "j3_asof_inclusive": "events", "w4_macd": "lineitem", "a12_threshold_statistics": "events"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in only:
        run = REGISTRY[name].run
        if os.path.isdir(warm_dir):
            run(spark, warm_dir).write.format("noop").mode("overwrite").save()
        begin = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    rates = {}
    for name, table in ROWS.items():
        if name in seconds:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
            rates[name] = round(rows / seconds[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "input_rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
