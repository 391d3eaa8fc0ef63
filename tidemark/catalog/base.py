"""Query registry and the common table expressions of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(fn: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return register


EV = """ev AS (SELECT event_id, ts, epoch_us(ts) AS t, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

TRADES = """trades AS (SELECT user_id % 10 AS pool, CAST(user_id AS VARCHAR) AS address,
  CASE WHEN event_type IN ('purchase','signup') THEN 'buy' WHEN event_type IN ('click','error') THEN 'sell' END AS side,
  value AS usd, t FROM ev)"""

SNAP = """snap AS (SELECT event_id AS id,
  CASE user_id % 3 WHEN 0 THEN 'bsc' WHEN 1 THEN 'solana' ELSE 'base' END AS chain,
  CASE user_id % 3 WHEN 0 THEN 'bsc' WHEN 1 THEN 'solana' ELSE 'base' END || ':' || user_id AS token_id,
  t, CASE WHEN event_type <> 'error' THEN value END AS price_usd, CAST(k AS DOUBLE) AS raw_score,
  CASE WHEN k >= 85 THEN 'BREAKOUT' WHEN k >= 70 THEN 'FAST_RISING' WHEN k >= 55 THEN 'WATCH' ELSE 'HIDDEN' END AS effective_tier,
  CASE event_type WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'GOOD' WHEN 'click' THEN 'MEDIUM' WHEN 'view' THEN 'LOW' ELSE '' END AS evidence_confidence,
  CASE WHEN k % 4 <> 0 THEN value * 100 END AS liquidity_usd,
  CASE WHEN k % 5 <> 0 THEN value * k END AS volume_m5_usd,
  CASE WHEN k % 3 <> 0 THEN k % 17 END AS buyers_m5,
  CASE WHEN k % 3 = 1 THEN k % 7 END AS sellers_m5,
  k % 13 AS aggregate_buyers_m5,
  CASE WHEN k % 2 = 0 THEN k % 11 END AS aggregate_sellers_m5,
  CASE WHEN event_type IN ('purchase','signup') THEN 'DEEP' ELSE 'FAST' END AS stage,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'completed' END AS deep_status,
  t - CAST(k AS BIGINT) * 7 * 60000000 AS pool_created_t
  FROM ev)"""

SCORES = """scores AS (SELECT s.* EXCLUDE (raw_score), v.score_version, v.role,
  CASE v.score_version WHEN 'V1' THEN s.raw_score ELSE CAST(CAST(s.raw_score * 7 + 13 AS BIGINT) % 100 AS DOUBLE) END AS raw_score
  FROM snap s CROSS JOIN (VALUES ('V1','CHAMPION'), ('V2','CHALLENGER')) v(score_version, role))"""

TICKS = """ticks AS (SELECT 'I' || (l_suppkey % 20) || '-USDT-SWAP' AS instrument_id, epoch_us(l_shipdate) AS t,
  l_orderkey AS seq1, l_linenumber AS seq2, l_extendedprice / l_quantity AS price, l_quantity AS base_volume,
  l_extendedprice AS quote_volume FROM lineitem)"""

ASOF = """clock AS (SELECT max(t) + 43200000000 AS as_of FROM ticks)"""

# Bar lengths in microseconds of the four stand-in frames.
FRAMES = """frames AS (SELECT * FROM (VALUES ('15m', 86400000000), ('1H', 172800000000), ('4H', 604800000000),
  ('1Dutc', 2419200000000)) f(timeframe, dur))"""

BARS = """bars AS (SELECT instrument_id, timeframe, t - t % dur AS open_t, t - t % dur + dur AS close_t,
  arg_min(price, (t, seq1, seq2, price)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, seq1, seq2, price)) AS close,
  sum(base_volume) AS volume_base, sum(CAST(round(quote_volume * 100) AS BIGINT)) / 100.0 AS volume_quote,
  t - t % dur + dur <= (SELECT as_of FROM clock) AS confirmed
  FROM ticks CROSS JOIN frames GROUP BY ALL)"""

DERIV = """deriv AS (SELECT event_id AS id, CASE WHEN user_id % 20 < 14 THEN 'crypto' ELSE 'stock' END AS asset_class,
  'I' || (user_id % 20) || '-USDT-SWAP' AS instrument_id, 'I' || (user_id % 20) AS symbol, t, value AS price_usd,
  (k - 50) / CAST(10 AS DOUBLE) AS change_24h_pct, value * 1000000 AS turnover_24h_usd,
  CASE WHEN event_type <> 'error' THEN value * (k + 1) * 1000 END AS open_interest_usd,
  CASE WHEN event_type <> 'view' THEN (k - 50) / CAST(100000 AS DOUBLE) END AS funding_rate FROM ev)"""

RUNS = """runs AS (SELECT run_id, finished_t, 'crypto' AS asset_class,
  CASE WHEN run_id % 7 = 0 THEN 'failed' WHEN run_id % 5 = 0 THEN 'degraded' ELSE 'completed' END AS status
  FROM (SELECT t // 1200000000 AS run_id, max(t) AS finished_t FROM ev GROUP BY 1))"""

MEMBERS = """members AS (SELECT t // 1200000000 AS run_id, 'I' || (user_id % 20) || '-USDT-SWAP' AS instrument_id,
  'I' || (user_id % 20) AS symbol, arg_max(value, event_id) AS price FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2, 3)"""

NEEDS = {
    "trades": ("ev",), "snap": ("ev",), "scores": ("snap",), "clock": ("ticks",), "bars": ("ticks", "clock", "frames"),
    "deriv": ("ev",), "runs": ("ev",), "members": ("ev",),
}
CTES = {
    "ev": EV, "trades": TRADES, "snap": SNAP, "scores": SCORES, "ticks": TICKS, "clock": ASOF, "frames": FRAMES,
    "bars": BARS, "deriv": DERIV, "runs": RUNS, "members": MEMBERS,
}


def define(name: str, text: str, *needs: str) -> None:
    """Add a shared table expression for the checking SQL."""
    CTES[name] = f"{name} AS MATERIALIZED ({text})"
    NEEDS[name] = needs


def oracle(body: str, *names: str) -> str:
    """SQL text with the named table expressions and everything they need, in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in NEEDS.get(name, ()):
            visit(dep)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    if not done:
        return body
    return "WITH RECURSIVE " + ",\n".join(CTES[n] for n in done) + "\n" + body
