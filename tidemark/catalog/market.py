"""Queries on bars, indicators, opportunities and price plans."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.catalog.base import define, oracle, query
from tidemark.functions.timecol import DAY, HOUR, micros
from tidemark.operators import bars as br, opportunity as op, smoothing as sm
from tidemark.operators.order_stats import grouped_median
from tidemark.plans import market_scan as scan
from tidemark.session import staged
from tidemark.sources import adapters as ad

BENCH = {"crypto": "I0-USDT-SWAP", "stock": "I14-USDT-SWAP"}


def bars(spark, sf_dir):
    ticks = ad.ticks(spark, sf_dir)
    return staged(br.resample(ticks, ad.as_of(ticks).select("as_of").scalar(), ad.TEST_FRAMES, ["seq1", "seq2", "price"]), "bars")


def indicator_sql(rows):
    """Recursive walk over completed bars numbered by idx; 0.0 stands for not ready."""
    e = lambda c, p: f"CASE WHEN b.idx < {p - 1} THEN 0 WHEN b.idx = {p - 1} THEN b.s{p} ELSE 2.0::DOUBLE / {p + 1} * b.close + (1 - 2.0::DOUBLE / {p + 1}) * r.{c} END"
    names = [("e12", 12), ("e20", 20), ("e26", 26), ("e50", 50), ("e200", 200)]
    first = ", ".join(f"0::DOUBLE AS {c}" for c, _ in names)
    steps = ", ".join(f"{e(c, p)} AS {c}" for c, p in names)
    seeds = ", ".join(f"avg(close) OVER (w ROWS {p - 1} PRECEDING) AS s{p}" for _, p in names)
    return f"""WITH RECURSIVE g0 AS (SELECT *, close - lag(close) OVER w AS ch, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
      FROM {rows} WINDOW w AS (PARTITION BY instrument_id, timeframe ORDER BY idx)),
    g AS MATERIALIZED (SELECT *, {seeds}, avg(greatest(ch, 0)) OVER (w ROWS 13 PRECEDING) AS sg, avg(greatest(-ch, 0)) OVER (w ROWS 13 PRECEDING) AS sl,
      avg(tr) OVER (w ROWS 13 PRECEDING) AS st FROM g0 WINDOW w AS (PARTITION BY instrument_id, timeframe ORDER BY idx)),
    walk AS (SELECT instrument_id, timeframe, idx, {first}, 0::DOUBLE AS ag, 0::DOUBLE AS al, 0::DOUBLE AS atr, 0::DOUBLE AS line_sum, 0::DOUBLE AS sig FROM g WHERE idx = 0
      UNION ALL
      SELECT instrument_id, timeframe, idx, e12, e20, e26, e50, e200, ag, al, atr, CASE WHEN idx >= 25 THEN line_sum + e12 - e26 ELSE 0 END,
        CASE WHEN idx < 33 THEN 0 WHEN idx = 33 THEN (line_sum + e12 - e26) / 9 ELSE 0.2::DOUBLE * (e12 - e26) + 0.8::DOUBLE * sig END
      FROM (SELECT b.instrument_id, b.timeframe, b.idx, {steps},
        CASE WHEN b.idx < 14 THEN 0 WHEN b.idx = 14 THEN b.sg ELSE (r.ag * 13 + greatest(b.ch, 0)) / 14 END AS ag,
        CASE WHEN b.idx < 14 THEN 0 WHEN b.idx = 14 THEN b.sl ELSE (r.al * 13 + greatest(-b.ch, 0)) / 14 END AS al,
        CASE WHEN b.idx < 13 THEN 0 WHEN b.idx = 13 THEN b.st ELSE (r.atr * 13 + b.tr) / 14 END AS atr, r.line_sum, r.sig
        FROM walk r JOIN g b ON b.instrument_id = r.instrument_id AND b.timeframe = r.timeframe AND b.idx = r.idx + 1))
    SELECT instrument_id, timeframe, idx, e20 AS ema20, e50 AS ema50, e200 AS ema200, atr AS atr14,
      CASE WHEN idx < 14 THEN 0 WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100 WHEN ag = 0 THEN 0 ELSE 100 - 100 / (1 + ag / al) END AS rsi14,
      CASE WHEN idx >= 25 THEN e12 - e26 ELSE 0 END AS macd, sig AS macd_signal, CASE WHEN idx >= 33 THEN e12 - e26 - sig ELSE 0 END AS hist FROM walk"""


define("cbars", "SELECT *, row_number() OVER (PARTITION BY instrument_id, timeframe ORDER BY open_t) - 1 AS idx FROM bars WHERE confirmed", "bars")
define("ind", indicator_sql("cbars"), "cbars")
define("nb", "SELECT *, row_number() OVER (PARTITION BY instrument_id, timeframe ORDER BY open_t) - 1 AS idx FROM bars", "bars")
define("fb", """SELECT *, confirmed AND prior_high > 0 AND close > prior_high AS breakout,
    coalesce(idx >= 21 AND lag(high) OVER w > lag(prior_high) OVER w AND close < lag(prior_high) OVER w, false) AS false_breakout
  FROM (SELECT *, coalesce(max(high) FILTER (confirmed) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS prior_high,
    coalesce(count(*) FILTER (confirmed) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5
      AND low < least(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w), false) AS low_pivot,
    coalesce(count(*) FILTER (confirmed) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5
      AND high > greatest(lag(high, 1) OVER w, lag(high, 2) OVER w, lead(high, 1) OVER w, lead(high, 2) OVER w), false) AS high_pivot,
    lag(close, 4) OVER w AS close_4_back
    FROM nb WINDOW w AS (PARTITION BY instrument_id, timeframe ORDER BY idx)) WINDOW w AS (PARTITION BY instrument_id, timeframe ORDER BY idx)""", "nb")

B = "instrument_id, timeframe, open_t AS open_us"


@query("w25_resampled_bars", oracle(f"SELECT {B}, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume_base, round(CAST(volume_quote AS DOUBLE), 2) AS volume_quote, confirmed FROM bars", "bars"))
def resampled_bars(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return bars(spark, sf_dir).select(
        "instrument_id", "timeframe", micros("open_time").alias("open_us"), r("open"), r("high"), r("low"), r("close"),
        "volume_base", F.round("volume_quote", 2).alias("volume_quote"), "confirmed",
    )


# Bars of the instruments with two-digit numbers are spoilt on some days and delivered twice on others.
@query("p19_series_validity", oracle("""SELECT instrument_id, timeframe, count(*) + count(*) FILTER (twice) AS bars, count(*) FILTER (confirmed) + count(*) FILTER (confirmed AND twice) AS completed,
  count(*) FILTER (bad) + count(*) FILTER (bad AND twice) AS invalid_bars, count(*) FILTER (twice) AS repeated_times,
  count(*) FILTER (confirmed) + count(*) FILTER (confirmed AND twice) >= 50 AND count(*) FILTER (bad) = 0 AND count(*) FILTER (twice) = 0 AS usable
  FROM (SELECT *, length(instrument_id) = 13 AND open_t // 86400000000 % 53 = 0 AS bad, length(instrument_id) = 13 AND open_t // 86400000000 % 71 = 5 AS twice FROM bars) GROUP BY 1, 2""", "bars"))
def series_validity(spark, sf_dir):
    day, late = F.floor(micros("open_time") / DAY), F.length("instrument_id") == 13
    rows = bars(spark, sf_dir)
    spoilt = rows.withColumn("high", F.when(late & (day % 53 == 0), F.col("low") / 2).otherwise(F.col("high")))
    return br.series_validity(spoilt.unionByName(spoilt.filter(late & (day % 71 == 5))))


@query("w1_completed_bars", oracle("SELECT timeframe, count(*) AS series, count(*) FILTER (n >= 50) AS usable FROM (SELECT instrument_id, timeframe, count(*) FILTER (confirmed) AS n FROM bars GROUP BY 1, 2) GROUP BY 1", "bars"))
def completed_bars(spark, sf_dir):
    per = bars(spark, sf_dir).groupBy(*br.SERIES).agg(F.count_if("confirmed").alias("n"))
    return per.groupBy("timeframe").agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("n") >= br.MIN_COMPLETED).alias("usable"))


def _ind(spark, sf_dir, *cols):
    df = br.completed_indicators(bars(spark, sf_dir))
    return df.select(*br.SERIES, micros("open_time").alias("open_us"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in cols])


def _ind_sql(**cols):
    body = ", ".join(f"round(CAST(i.{src} AS DOUBLE), 4) AS {name}" for name, src in cols.items())
    return oracle(f"SELECT instrument_id, timeframe, c.open_t AS open_us, {body} FROM ind i JOIN cbars c USING (instrument_id, timeframe, idx)", "ind", "cbars")


@query("w2_ema", _ind_sql(ema20="ema20", ema50="ema50", ema200="ema200"))
def ema(spark, sf_dir):
    return _ind(spark, sf_dir, "ema20", "ema50", "ema200")


@query("w3_rsi", _ind_sql(rsi14="rsi14"))
def rsi(spark, sf_dir):
    return _ind(spark, sf_dir, "rsi14")


@query("w4_macd", _ind_sql(macd="macd", macd_signal="macd_signal", macd_histogram="hist"))
def macd(spark, sf_dir):
    return _ind(spark, sf_dir, "macd", "macd_signal", "macd_histogram")


@query("w5_atr", _ind_sql(atr14="atr14"))
def atr(spark, sf_dir):
    return _ind(spark, sf_dir, "atr14")


def _features(spark, sf_dir):
    return br.bar_features(bars(spark, sf_dir))


@query("w7_pivots", oracle(f"SELECT {B}, low_pivot, high_pivot FROM fb WHERE low_pivot OR high_pivot", "fb"))
def pivots(spark, sf_dir):
    return _features(spark, sf_dir).filter("low_pivot OR high_pivot").select(
        *br.SERIES, micros("open_time").alias("open_us"), "low_pivot", "high_pivot"
    )


@query("w8_prior_high", oracle(f"SELECT {B}, round(prior_high, 6) AS prior_high FROM fb", "fb"))
def prior_high(spark, sf_dir):
    return _features(spark, sf_dir).select(
        *br.SERIES, micros("open_time").alias("open_us"), F.round("prior_high", 6).alias("prior_high")
    )


@query("w9_breakouts", oracle("SELECT instrument_id, timeframe, count(*) FILTER (breakout) AS breakouts FROM fb GROUP BY 1, 2", "fb"))
def breakouts(spark, sf_dir):
    return _features(spark, sf_dir).groupBy(*br.SERIES).agg(F.count_if("breakout").alias("breakouts"))


@query("w10_false_breakouts", oracle(f"SELECT {B} FROM fb WHERE false_breakout", "fb"))
def false_breakouts(spark, sf_dir):
    return _features(spark, sf_dir).filter("false_breakout").select(*br.SERIES, micros("open_time").alias("open_us"))


@query("w12_price_move", oracle(f"SELECT {B}, round(close - close_4_back, 8) AS price_move FROM fb WHERE close_4_back IS NOT NULL", "fb"))
def price_move(spark, sf_dir):
    return _features(spark, sf_dir).filter(F.col("close_4_back").isNotNull()).select(
        *br.SERIES, micros("open_time").alias("open_us"), (F.round(F.col("close") - F.col("close_4_back"), 8) + 0.0).alias("price_move")
    )


define("rret", """SELECT instrument_id, CASE WHEN count(*) >= 5 THEN (max(close) FILTER (rn = 1) / max(close) FILTER (rn = 5) - 1) * 100 ELSE 0 END AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY open_t DESC) AS rn FROM bars WHERE confirmed AND timeframe = '1H') WHERE rn <= 5 GROUP BY 1""", "bars")


@query("w11_recent_return", oracle("SELECT instrument_id, round(r, 6) AS recent_return FROM rret", "rret"))
def recent_return(spark, sf_dir):
    out = br.recent_returns(bars(spark, sf_dir))
    return out.select("instrument_id", (F.round("recent_return", 6) + 0.0).alias("recent_return"))


CLS = "CASE WHEN CAST(regexp_extract(instrument_id, 'I([0-9]+)-', 1) AS INTEGER) < 14 THEN 'crypto' ELSE 'stock' END"


@query("a10_pool_median_return", oracle(f"SELECT {CLS} AS asset_class, round(quantile_cont(r, 0.5), 6) AS pool_median_return FROM rret GROUP BY 1", "rret"))
def pool_median_return(spark, sf_dir):
    r = br.recent_returns(bars(spark, sf_dir)).withColumn(
        "asset_class", F.when(F.regexp_extract("instrument_id", "I([0-9]+)-", 1).cast("int") < 14, "crypto").otherwise("stock")
    )
    m = grouped_median(r, ["asset_class"], "recent_return", "pool_median_return")
    return m.select("asset_class", (F.round("pool_median_return", 6) + 0.0).alias("pool_median_return"))


@query("j13_benchmark_return", oracle(f"""SELECT a.instrument_id, round(a.r, 6) AS asset_return, round(b.r, 6) AS benchmark_return, a.r > b.r AS stronger FROM (SELECT *, {CLS} AS cls FROM rret) a
  JOIN (SELECT *, {CLS} AS cls FROM rret WHERE instrument_id IN ('I0-USDT-SWAP', 'I14-USDT-SWAP')) b USING (cls)""", "rret"))
def benchmark_return(spark, sf_dir):
    made = bars(spark, sf_dir)
    r = br.recent_returns(made)
    assets = latest(spark, sf_dir).select("instrument_id", "asset_class")
    context = scan.pool_context(made, assets, BENCH)
    out = r.join(assets, "instrument_id").join(context, "asset_class")
    return out.select(
        "instrument_id", (F.round("recent_return", 6) + 0.0).alias("asset_return"),
        (F.round("benchmark_return", 6) + 0.0).alias("benchmark_return"), (F.col("recent_return") > F.col("benchmark_return")).alias("stronger"),
    )


# ---- readings at the end of a series ----------------------------------------------------------------

define("b3", """SELECT *, count(*) OVER p AS n, count(*) FILTER (confirmed) OVER p AS m, max(idx) FILTER (confirmed) OVER p AS lastc,
    coalesce(max(high) FILTER (confirmed) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS prior_high,
    coalesce(count(*) FILTER (confirmed) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5
      AND low < least(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w), false) AS low_pivot
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, timeframe ORDER BY open_t) - 1 AS idx
    FROM bars)
  WINDOW p AS (PARTITION BY instrument_id, timeframe), w AS (PARTITION BY instrument_id, timeframe ORDER BY idx)""", "bars")
define("c3", "SELECT * EXCLUDE (idx), row_number() OVER (PARTITION BY instrument_id, timeframe ORDER BY idx) - 1 AS idx FROM b3 WHERE confirmed", "b3")
define("i3", indicator_sql("c3"), "c3")
define("fi", """SELECT c.*, i.* EXCLUDE (instrument_id, timeframe, idx) FROM c3 c JOIN i3 i USING (instrument_id, timeframe, idx)""", "c3", "i3")
define("rd", """SELECT * FROM (SELECT instrument_id, timeframe, max(n) AS n, max(m) AS m, max(close) FILTER (idx = n - 1) AS lclose, max(volume_quote) FILTER (idx = n - 1) AS lvol,
    max(open_t) FILTER (idx = n - 1) AS lopen, max(close_t) FILTER (idx = n - 1) AS lct, bool_or(confirmed) FILTER (idx = n - 1) AS lconf,
    max(close) FILTER (idx = greatest(0, n - 5)) AS c5, max(prior_high) FILTER (idx = n - 1) AS lph, max(prior_high) FILTER (idx = n - 2) AS pph, max(high) FILTER (idx = n - 2) AS phigh,
    max(close) FILTER (idx = lastc) AS cclose, max(prior_high) FILTER (idx = lastc) AS cph, max(close) FILTER (idx = greatest(0, lastc - 4)) AS c4,
    max(close) FILTER (idx = m - 11) AS close10,
    max(high) FILTER (confirmed AND idx >= CASE WHEN lastc = n - 1 THEN n - 1 ELSE n END - 20 AND idx < CASE WHEN lastc = n - 1 THEN n - 1 ELSE n END) AS conf_level,
    coalesce(list(low ORDER BY idx DESC) FILTER (low_pivot)[1] > list(low ORDER BY idx DESC) FILTER (low_pivot)[2], false) AS higher_low
    FROM b3 WHERE m >= 50 GROUP BY 1, 2) a
  JOIN (SELECT instrument_id, timeframe, quantile_cont(volume_quote, 0.5) FILTER (idx >= m - 20) AS vmed, max(close) FILTER (idx = m - 5) AS cc4,
    max(ema20) FILTER (idx = m - 1) AS ema20, max(ema50) FILTER (idx = m - 1) AS ema50, max(rsi14) FILTER (idx = m - 1) AS rsi, max(hist) FILTER (idx = m - 1) AS h0,
    max(hist) FILTER (idx = m - 2) AS h1, max(hist) FILTER (idx = m - 3) AS h2, max(atr14) FILTER (idx = m - 1) AS atr, max(rsi14) FILTER (idx = m - 11) AS rsi10,
    coalesce(bool_or(rsi14 BETWEEN 35 AND 45) FILTER (idx >= m - 20 AND idx < m - 1), false) AS rsi_low FROM fi GROUP BY 1, 2) b USING (instrument_id, timeframe)""", "b3", "fi")


def readings(spark, sf_dir):
    return br.frame_readings(bars(spark, sf_dir))


@query("w6_volume_median", oracle("SELECT instrument_id, timeframe, round(CAST(vmed AS DOUBLE), 4) AS volume_median20 FROM rd", "rd"))
def volume_median(spark, sf_dir):
    return readings(spark, sf_dir).select(*br.SERIES, F.round("volume_median20", 4).alias("volume_median20"))


@query("w13_bearish_divergence", oracle("SELECT instrument_id, timeframe, coalesce(cclose > close10 AND rsi < rsi10, false) AS bearish_divergence FROM rd", "rd"))
def bearish_divergence(spark, sf_dir):
    flag = (F.col("last_close") > F.col("close_10")) & (F.col("rsi14") < F.col("rsi_10"))
    return readings(spark, sf_dir).select(*br.SERIES, F.coalesce(flag, F.lit(False)).alias("bearish_divergence"))


@query("w14_rsi_recovered", oracle("SELECT instrument_id, timeframe, rsi_low, round(rsi, 4) AS rsi14, rsi > 50 AND rsi_low AS recovered FROM rd", "rd"))
def rsi_recovered(spark, sf_dir):
    return readings(spark, sf_dir).select(
        *br.SERIES, F.col("rsi_was_low").alias("rsi_low"), F.round("rsi14", 4).alias("rsi14"),
        ((F.col("rsi14") > 50) & F.col("rsi_was_low")).alias("recovered"),
    )


@query("w15_macd_flip", oracle("SELECT instrument_id, timeframe, h2 < h1 AND h1 <= 0 AND h0 > 0 AS macd_flip FROM rd", "rd"))
def macd_flip(spark, sf_dir):
    c = F.col
    flip = (c("histogram_2") < c("histogram_1")) & (c("histogram_1") <= 0) & (c("macd_histogram") > 0)
    return readings(spark, sf_dir).select(*br.SERIES, flip.alias("macd_flip"))


@query("w16_higher_low", oracle("SELECT instrument_id, timeframe, higher_low FROM rd", "rd"))
def higher_low(spark, sf_dir):
    return readings(spark, sf_dir).select(*br.SERIES, "higher_low")


VR = """CASE WHEN vmed > 0 THEN CASE WHEN lconf THEN lvol ELSE least(lvol / least(1, greatest(0.1, ((SELECT as_of FROM clock) - lopen) / CAST(lct - lopen AS DOUBLE))), vmed * 3) END / vmed ELSE 0 END"""


@query("w17_volume_ratio", oracle(f"SELECT instrument_id, timeframe, round(CAST({VR} AS DOUBLE), 6) AS volume_ratio FROM rd", "rd", "clock"))
def volume_ratio(spark, sf_dir):
    as_of = ad.as_of(ad.ticks(spark, sf_dir)).select("as_of").scalar()
    r = readings(spark, sf_dir)
    names = [c for c in r.columns if c not in br.SERIES]
    ratio = op.normalized_volume_ratio(F.col("frame"), as_of)
    return r.select(*br.SERIES, F.struct(*names).alias("frame")).select(*br.SERIES, F.round(ratio, 6).alias("volume_ratio"))


# ---- opportunities -----------------------------------------------------------------------------


def latest(spark, sf_dir):
    d = ad.derivatives(spark, sf_dir)
    return scan.oi_changes(scan.latest_derivatives(d), d, 6 * HOUR, 24 * HOUR).withColumn("tick_size", F.lit(0.01))


def scored(spark, sf_dir, made=None):
    as_of = ad.as_of(ad.ticks(spark, sf_dir)).select("as_of").scalar()
    return scan.scan(bars(spark, sf_dir) if made is None else made, latest(spark, sf_dir), as_of, BENCH)


define("cur", "SELECT * FROM deriv QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY t DESC, id DESC) = 1", "deriv")
_base = lambda back: f"(SELECT arg_max(coalesce(b.open_interest_usd, -1), (b.t, b.id)) FROM deriv b WHERE b.instrument_id = cur.instrument_id AND b.t <= cur.t - {back})"
define("assets", f"""SELECT *, CASE WHEN open_interest_usd > 0 AND b15 > 0 THEN (open_interest_usd / b15 - 1) * 100 END AS oi15,
  CASE WHEN open_interest_usd > 0 AND b60 > 0 THEN (open_interest_usd / b60 - 1) * 100 END AS oi60
  FROM (SELECT *, {_base(21600000000)} AS b15, {_base(86400000000)} AS b60 FROM cur)""", "cur")
define("wide", """SELECT e.instrument_id, a.* EXCLUDE (instrument_id), b.r AS bench_r, p.med AS pool_med, x.r AS asset_r,
  e.n AS e_n, e.lclose AS e_lclose, e.c5 AS e_c5, e.lph AS e_lph, e.pph AS e_pph, e.phigh AS e_phigh, e.cclose AS e_cclose, e.cph AS e_cph, e.close10 AS e_close10, e.conf_level AS e_conf,
  e.ema20 AS e_ema20, e.rsi AS e_rsi, e.rsi10 AS e_rsi10, e.atr AS e_atr, e.lconf AS e_lconf, e.vr AS vr,
  r.cclose AS r_close, r.c4 AS r_c4, r.atr AS r_atr, r.rsi AS r_rsi, r.rsi_low AS r_rsi_low, r.h0 AS r_h0, r.h1 AS r_h1, r.h2 AS r_h2, r.higher_low AS r_hl,
  t.cclose AS t_close, t.ema20 AS t_ema20, t.ema50 AS t_ema50, t.atr AS t_atr, d.cclose AS d_close, d.ema20 AS d_ema20, d.ema50 AS d_ema50, d.h0 AS d_h0, d.h1 AS d_h1, d.atr AS d_atr
  FROM (SELECT *, """ + VR + """ AS vr FROM rd WHERE timeframe = '15m') e JOIN (SELECT * FROM rd WHERE timeframe = '1H') r USING (instrument_id)
  JOIN (SELECT * FROM rd WHERE timeframe = '4H') t USING (instrument_id) JOIN (SELECT * FROM rd WHERE timeframe = '1Dutc') d USING (instrument_id)
  JOIN assets a USING (instrument_id) JOIN rret x USING (instrument_id)
  JOIN (SELECT asset_class, r FROM rret JOIN assets USING (instrument_id) WHERE instrument_id IN ('I0-USDT-SWAP', 'I14-USDT-SWAP')) b USING (asset_class)
  JOIN (SELECT asset_class, quantile_cont(r, 0.5) AS med FROM rret JOIN assets USING (instrument_id) GROUP BY 1) p USING (asset_class)""", "rd", "clock", "assets", "rret")
define("sig1", """SELECT *, e_lclose - e_c5 AS move, (e_cph > 0 AND e_cclose > e_cph) AS done_break, (e_cph > 0 AND e_cclose > e_cph) OR (e_lph > 0 AND e_lclose > e_lph) AS brk,
  e_n >= 22 AND e_phigh > e_pph AND e_lclose < e_pph AS false_brk, coalesce(e_cclose > e_close10 AND e_rsi < e_rsi10, false) AS div, coalesce(funding_rate >= 0.0005, false) AS crowded,
  r_rsi > 50 AND r_rsi_low AS recovered, r_h2 < r_h1 AND r_h1 <= 0 AND r_h0 > 0 AS flip, r_hl AND (vr >= 1.2 OR coalesce(oi60 > 0, false)) AS hl FROM wide""", "wide")
define("sig2", """SELECT *,
  CASE WHEN e_atr <= 0 OR r_atr <= 0 THEN 0 WHEN move / e_atr >= 1 AND (r_close - r_c4) / r_atr >= 1 THEN 25
    WHEN (move / e_atr >= 1 AND (r_close - r_c4) / r_atr >= 0.25) OR ((r_close - r_c4) / r_atr >= 1 AND move > 0) THEN 18
    WHEN move > 0 AND r_close - r_c4 > 0 THEN 12 ELSE 0 END AS price_points,
  CASE WHEN vr >= 2 THEN 25 WHEN vr >= 1.5 THEN 18 WHEN vr >= 1.2 THEN 10 ELSE 0 END AS volume_points,
  CASE WHEN brk THEN 20 WHEN e_lclose > e_ema20 THEN 10 ELSE 0 END AS breakout_points,
  CASE WHEN oi15 > 0 AND move > 0 THEN 15 WHEN oi60 > 0 AND move > 0 THEN 10 ELSE 0 END AS oi_points,
  CASE WHEN asset_r > bench_r AND asset_r > pool_med THEN 15 WHEN asset_r > 0 THEN 7 ELSE 0 END AS relative_points,
  e_rsi > 80 AND div AS risk_div, e_atr > 0 AND e_lclose - e_ema20 > 2 * e_atr AS risk_ext,
  CASE WHEN d_close > d_ema20 AND d_close > d_ema50 AND d_h0 >= d_h1 THEN 15 WHEN d_close > least(d_ema20, d_ema50) THEN 8 ELSE 0 END AS daily_score,
  5 + CASE WHEN t_close > t_ema20 THEN 10 ELSE 0 END + CASE WHEN t_ema20 > t_ema50 THEN 10 ELSE 0 END AS trend_score,
  CAST(recovered AS INTEGER) + CAST(flip AS INTEGER) + CAST(hl AS INTEGER) AS checks,
  CASE WHEN done_break THEN 20 WHEN brk THEN 10 ELSE 5 END AS execution_score,
  CASE WHEN vr >= 1.2 THEN 5 ELSE 0 END + CASE WHEN oi15 > 0 THEN 5 ELSE 0 END + CASE WHEN crowded THEN 0 ELSE 5 END AS derivatives_score,
  coalesce(d_close > 0 AND d_atr / d_close >= 0.08 OR abs(change_24h_pct) >= 15, false) AS high_vol FROM sig1""", "sig1")
define("sig3", """SELECT *, least(100, greatest(0, price_points + volume_points + breakout_points + oi_points + relative_points - CASE WHEN risk_div THEN 10 ELSE 0 END
    - CASE WHEN risk_ext THEN 10 ELSE 0 END - CASE WHEN crowded THEN 5 ELSE 0 END - CASE WHEN false_brk THEN 10 ELSE 0 END)) AS start_score,
  CASE WHEN checks >= 2 THEN 25 WHEN checks = 1 THEN 12 ELSE 0 END AS reversal_score, e_rsi > 80 AND (risk_div OR vr < 1 OR crowded) AS overheated FROM sig2""", "sig2")
define("sig4", """SELECT *, CASE WHEN daily_score = 0 AND nat NOT IN ('NONE', 'PRELAUNCH') THEN 'PRELAUNCH' ELSE nat END AS stage, daily_score = 0 AND nat NOT IN ('NONE', 'PRELAUNCH') AS veto,
  daily_score + trend_score + reversal_score + execution_score + derivatives_score AS opportunity_score
  FROM (SELECT *, CASE WHEN start_score < 50 THEN 'NONE' WHEN overheated THEN 'OVERHEATED' WHEN start_score < 65 THEN 'PRELAUNCH'
    WHEN start_score >= 80 AND checks >= 2 AND NOT false_brk AND done_break THEN CASE WHEN start_score >= 90 THEN 'ACCELERATING' ELSE 'CONFIRMED' END ELSE 'STARTING' END AS nat FROM sig3)""", "sig3")


def _int(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _isql(*names):
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


@query("c13_start_score", oracle("SELECT instrument_id, " + _isql("price_points", "volume_points", "breakout_points", "oi_points", "relative_points", "start_score") + " FROM sig4", "sig4"))
def start_score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "instrument_id", *_int("price_points", "volume_points", "breakout_points", "oi_points", "relative_points", "start_score")
    )


@query("c14_price_acceleration", oracle("SELECT instrument_id, round(move, 6) AS price_move, CAST(price_points AS BIGINT) AS price_points FROM sig4", "sig4"))
def price_acceleration(spark, sf_dir):
    return scored(spark, sf_dir).select("instrument_id", (F.round("price_move", 6) + 0.0).alias("price_move"), *_int("price_points"))


@query("c15_c16_trend_evidence", oracle("SELECT instrument_id, daily_score > 0 AS long_allowed, " + _isql("daily_score", "trend_score") + " FROM sig4", "sig4"))
def trend_evidence(spark, sf_dir):
    return scored(spark, sf_dir).select("instrument_id", "long_allowed", *_int("daily_score", "trend_score"))


@query("c17_reversal", oracle("SELECT instrument_id, recovered AS rsi_recovered, flip AS macd_flip, hl AS higher_low, checks >= 2 AS reversal_confirmed, CAST(reversal_score AS BIGINT) AS reversal_score FROM sig4", "sig4"))
def reversal(spark, sf_dir):
    return scored(spark, sf_dir).select("instrument_id", "rsi_recovered", "macd_flip", "higher_low", "reversal_confirmed", *_int("reversal_score"))


@query("c18_execution", oracle("SELECT instrument_id, brk AS breakout, done_break AS completed_breakout, " + _isql("execution_score", "derivatives_score") + " FROM sig4", "sig4"))
def execution(spark, sf_dir):
    return scored(spark, sf_dir).select("instrument_id", "breakout", "completed_breakout", *_int("execution_score", "derivatives_score"))


# Every score meets every kind of confirmation, so that all six stages and the veto occur.
@query("c19_stages_of_scores", oracle("""SELECT event_id, CASE WHEN veto THEN 'PRELAUNCH' ELSE nat END AS stage, veto AS vetoed FROM
  (SELECT *, event_id % 5 = 0 AND nat NOT IN ('NONE', 'PRELAUNCH') AS veto FROM (SELECT *, CASE WHEN k < 50 THEN 'NONE' WHEN event_id % 13 = 0 THEN 'OVERHEATED' WHEN k < 65 THEN 'PRELAUNCH'
    WHEN event_id % 2 = 0 AND event_id % 7 <> 0 AND event_id % 3 <> 0 AND k >= 80 THEN CASE WHEN k >= 90 THEN 'ACCELERATING' ELSE 'CONFIRMED' END ELSE 'STARTING' END AS nat FROM ev))""", "ev"))
def stages_of_scores(spark, sf_dir):
    e = F.col("event_id")
    given = ad.adapt_events(ad.table(spark, sf_dir, "events")).select(
        e, F.col("k").alias("start_score"), (e % 13 == 0).alias("overheated"), (e % 2 == 0).alias("reversal_confirmed"), (e % 7 == 0).alias("false_breakout"),
        (e % 3 != 0).alias("completed_breakout"), (e % 5 != 0).alias("long_allowed"),
    )
    return op.with_stage(given).select("event_id", "stage", "vetoed")


@query("c19_stage", oracle("""SELECT instrument_id, CAST(start_score AS BIGINT) AS start_score, CAST(opportunity_score AS BIGINT) AS opportunity_score, stage,
  concat_ws(',', CASE WHEN risk_div THEN 'BEARISH_DIVERGENCE' END, CASE WHEN crowded THEN 'CROWDED_FUNDING' END, CASE WHEN veto THEN 'DAILY_VETO' END,
    CASE WHEN risk_ext THEN 'EXTENDED_ABOVE_EMA20' END, CASE WHEN false_brk THEN 'FALSE_BREAKOUT' END) AS risk_flags FROM sig4""", "sig4"))
def stage(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "instrument_id", *_int("start_score", "opportunity_score"), "stage", F.array_join("risk_flags", ",").alias("risk_flags")
    )


@query("p22_high_volatility", oracle("SELECT instrument_id, high_vol AS high_volatility, round(change_24h_pct, 6) AS change_24h_pct FROM sig4", "sig4"))
def high_volatility(spark, sf_dir):
    return scored(spark, sf_dir).select("instrument_id", "high_volatility", F.round("change_24h_pct", 6).alias("change_24h_pct"))


@query("c20_oi_change", oracle("SELECT instrument_id, round(oi15, 6) AS oi_change_15m, round(oi60, 6) AS oi_change_1h FROM assets", "assets"))
def oi_change(spark, sf_dir):
    return latest(spark, sf_dir).select(
        "instrument_id", (F.round("oi_change_15m", 6) + 0.0).alias("oi_change_15m"), (F.round("oi_change_1h", 6) + 0.0).alias("oi_change_1h")
    )


@query("o3_top_opportunities", oracle("""SELECT asset_class, rn AS rank, instrument_id, CAST(opportunity_score AS BIGINT) AS opportunity_score FROM
  (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY opportunity_score DESC, start_score DESC, instrument_id) AS rn FROM sig4) WHERE rn <= 10""", "sig4"))
def top_opportunities(spark, sf_dir):
    return op.top_opportunities(scored(spark, sf_dir), ["asset_class"]).select(
        "asset_class", F.col("rank").cast("bigint").alias("rank"), "instrument_id", *_int("opportunity_score")
    )


@query("c27_run_status", oracle("""SELECT asset_class, CASE WHEN warned = 0 THEN 'completed' WHEN analysed > 0 THEN 'degraded' ELSE 'failed' END AS status, analysed, warned AS warnings
  FROM (SELECT a.asset_class, count(s.instrument_id) AS analysed, count(*) - count(s.instrument_id) AS warned FROM assets a LEFT JOIN sig4 s USING (instrument_id) GROUP BY 1)""", "assets", "sig4"))
def run_status(spark, sf_dir):
    assets = latest(spark, sf_dir).select("instrument_id", "asset_class")
    done = scored(spark, sf_dir).select("instrument_id", F.lit(1).alias("done"))
    per = assets.join(done, "instrument_id", "left").groupBy("asset_class").agg(
        F.count("done").alias("analysed"), F.count_if(F.col("done").isNull()).alias("warnings")
    )
    return per.select("asset_class", op.run_status(F.col("analysed"), F.col("warnings")).alias("status"), "analysed", "warnings")


# ---- levels and plans ---------------------------------------------------------------------------

define("h4", """SELECT *, coalesce(count(*) FILTER (confirmed) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5
      AND low < least(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w), false) AS lp,
    coalesce(count(*) FILTER (confirmed) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5
      AND high > greatest(lag(high, 1) OVER w, lag(high, 2) OVER w, lead(high, 1) OVER w, lead(high, 2) OVER w), false) AS hp
  FROM (SELECT * FROM b3 WHERE timeframe = '4H' AND idx >= n - 60) WINDOW w AS (PARTITION BY instrument_id ORDER BY idx)""", "b3")
define("pv", """SELECT s.instrument_id, s.e_lclose AS cur_price, s.t_atr AS atr, kind, price FROM sig4 s JOIN (
    SELECT instrument_id, 'low' AS kind, low AS price FROM h4 WHERE lp UNION ALL SELECT instrument_id, 'high', high FROM h4 WHERE hp
    UNION ALL SELECT instrument_id, 'low', t_ema20 FROM sig4 WHERE t_ema20 > 0 AND t_ema20 < e_lclose
    UNION ALL SELECT instrument_id, 'low', t_ema50 FROM sig4 WHERE t_ema50 > 0 AND t_ema50 < e_lclose) p USING (instrument_id) WHERE s.t_atr > 0 AND s.stage <> 'NONE'""", "sig4", "h4")
define("zones", """SELECT instrument_id, cur_price, kind, zone, min(price) AS zl, max(price) AS zh, count(*) AS strength FROM
  (SELECT *, sum(isnew) OVER (PARTITION BY instrument_id, kind ORDER BY price ROWS UNBOUNDED PRECEDING) AS zone FROM
    (SELECT *, CASE WHEN coalesce(price - lag(price) OVER (PARTITION BY instrument_id, kind ORDER BY price) > 0.5 * atr, true) THEN 1 ELSE 0 END AS isnew FROM pv)) GROUP BY 1, 2, 3, 4""", "pv")
define("lv", """SELECT instrument_id, arg_max({'l': zl, 'h': zh}, zh) FILTER (kind = 'low' AND zh < cur_price) AS sup,
  list(zl ORDER BY zl) FILTER (kind = 'high' AND zl > cur_price) AS res FROM zones GROUP BY 1""", "zones")
DOWN = lambda x: f"round(floor(({x}) / 0.01 + 1e-10) * 0.01 * 10000) / 10000"
UP = lambda x: f"round(ceil(({x}) / 0.01 - 1e-10) * 0.01 * 10000) / 10000"


def define_plan(name, levels, *needs):
    """The plan of every row of a table with price (e_lclose), zone (sl, sh0, sh), t_atr, e_conf, res and the scores."""
    define(f"{name}1", f"""SELECT *, {DOWN('sh')} AS p1, {DOWN('(sl + sh) / 2')} AS p2, {DOWN('sl')} AS p3, {UP('CASE WHEN coalesce(e_conf, 0) <= sh0 THEN e_lclose ELSE e_conf END')} AS pc,
  {DOWN('sl - 0.5 * t_atr')} AS stop, {UP('res[1]')} AS t1 FROM (SELECT *, CASE WHEN sh0 - sl < 0.5 * t_atr THEN sl + 0.5 * t_atr ELSE sh0 END AS sh FROM ({levels}))""", *needs)
    define(f"{name}2", f"""SELECT *, (t1 - fa) / (fa - stop) AS rr1, CASE WHEN t2a <= t1 THEN {UP('t1 + fa - stop')} ELSE t2a END AS t2 FROM
  (SELECT *, CASE WHEN res[2] > t1 THEN {UP('res[2]')} ELSE {UP('fa + 2 * (fa - stop)')} END AS t2a, (fa - stop) / fa * 100 AS risk FROM
  (SELECT *, p1 * 0.3::DOUBLE + p2 * 0.25::DOUBLE + p3 * 0.25::DOUBLE + pc * 0.2::DOUBLE AS fa FROM {name}1))""", f"{name}1")
    define(f"{name}3", f"""SELECT *, CASE WHEN daily_score = 0 THEN 'daily_veto' WHEN NOT coalesce(t_atr > 0, false) THEN 'no_atr' WHEN sl IS NULL THEN 'no_support'
  WHEN start_score < CASE WHEN high_vol THEN 70 ELSE 65 END THEN 'low_score' WHEN NOT (sl > 0 AND sh < e_lclose) THEN 'support_not_below_price'
  WHEN coalesce(len(res), 0) = 0 THEN 'no_resistance' WHEN NOT (p1 > p2 AND p2 > p3) THEN 'entries_collapse' WHEN NOT (p3 > 0 AND pc > 0) THEN 'entry_not_positive'
  WHEN NOT (stop > 0 AND stop < fa) THEN 'bad_stop' WHEN risk > 15 + 1e-9 THEN 'risk_too_high' WHEN NOT (t1 > fa AND t1 > e_lclose) THEN 'target_not_above'
  WHEN rr1 < 1.3 - 1e-9 THEN 'reward_too_low' END AS why FROM {name}2""", f"{name}2")


def plan_sql(ident, src):
    """Ident, rejection and, of accepted plans, the levels."""
    kept = {"entry_1": "p1", "entry_3": "p3", "full_average_cost": "fa", "stop_price": "stop", "risk_pct": "risk", "target_1": "t1", "target_2": "t2", "reward_risk_1": "rr1"}
    return oracle(f"SELECT {ident}, why AS plan_rejection, " + ", ".join(f"CASE WHEN why IS NULL THEN round({c}, 4) END AS {n}" for n, c in kept.items()) + f" FROM {src}", src)


define_plan("pl", "SELECT *, sup.l AS sl, sup.h AS sh0 FROM sig4 LEFT JOIN lv USING (instrument_id) WHERE stage <> 'NONE'", "sig4", "lv")
# Plans around the price of every part: zones, targets, swings and scores of all kinds, so that plans are accepted and refused for every reason.
define_plan("pp", """SELECT k AS part, x AS e_lclose, CASE WHEN k % 23 <> 0 THEN x * (80 + k % 18) / 100 END AS sl, CASE WHEN k % 23 <> 0 THEN x * (80 + k % 18) / 100 + x * (k % 4) / 100 END AS sh0,
  CASE WHEN k % 17 = 0 THEN 0 ELSE x * (1 + k % 3) / 100 END AS t_atr, CASE WHEN k % 3 <> 0 THEN x * (200 + k % 5) / 200 END AS e_conf,
  CASE WHEN k % 19 = 0 THEN [] ELSE [x * (101 + 5 * (k % 13)) / 100, x * (120 + 10 * (k % 7)) / 100] END AS res, CASE WHEN k % 11 = 0 THEN 0 ELSE 8 END AS daily_score,
  60 + k % 40 AS start_score, k % 5 = 0 AS high_vol FROM (SELECT p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS x FROM part)""")


@query("c23_level_clusters", oracle("SELECT instrument_id, kind, CAST(zone AS BIGINT) AS zone, round(zl, 6) AS zone_low, round(zh, 6) AS zone_high, strength FROM zones WHERE kind = 'high'", "zones"))
def level_clusters(spark, sf_dir):
    made = bars(spark, sf_dir)
    shown = op.visible(scored(spark, sf_dir, made)).select("instrument_id", F.col(f"f{op.TREND}")["atr14"].alias("atr")).filter("atr > 0")
    pivots = br.level_pivots(made).filter(F.col("kind") == "high")
    zones = op.cluster_levels(pivots.join(shown, "instrument_id"), ["instrument_id", "kind", "atr"], F.col("atr") * 0.5)
    return zones.select(
        "instrument_id", "kind", F.col("zone").cast("bigint").alias("zone"), F.round("zone_low", 6).alias("zone_low"),
        F.round("zone_high", 6).alias("zone_high"), "strength",
    )


def plans(spark, sf_dir):
    made = bars(spark, sf_dir)
    return scan.with_plans(scored(spark, sf_dir, made), made)


@query("c24_nearest_levels", oracle("SELECT instrument_id, round(sup.l, 4) AS support_low, round(sup.h, 4) AS support_high, round(res[1], 4) AS resistance_1, round(res[2], 4) AS resistance_2, CAST(coalesce(len(res), 0) AS BIGINT) AS resistances FROM pl1", "pl1"))
def nearest_levels(spark, sf_dir):
    made = bars(spark, sf_dir)
    levelled = op.with_levels(staged(op.visible(scored(spark, sf_dir, made)), "visible"), br.level_pivots(made))
    res = F.col("resistances")
    return levelled.select(
        "instrument_id", F.round("support.low", 4).alias("support_low"), F.round("support.high", 4).alias("support_high"),
        F.round(F.get(res, F.lit(0))["low"], 4).alias("resistance_1"), F.round(F.get(res, F.lit(1))["low"], 4).alias("resistance_2"),
        F.coalesce(F.size(res), F.lit(0)).cast("bigint").alias("resistances"),
    )


PLAN_LEVELS = ("entry_1", "entry_3", "full_average_cost", "stop_price", "risk_pct", "target_1", "target_2", "reward_risk_1")


@query("c25_price_plan", plan_sql("instrument_id", "pl3"))
def price_plan(spark, sf_dir):
    return plans(spark, sf_dir).select("instrument_id", "plan_rejection", *[F.round(c, 4).alias(c) for c in PLAN_LEVELS])


@query("c25_plans_of_parts", plan_sql("part", "pp3"))
def plans_of_parts(spark, sf_dir):
    k, x = F.col("p_partkey"), F.col("p_retailprice").cast("double")
    low = x * (80 + k % 18) / 100
    level = lambda price: F.struct(price.alias("low"))
    levels = F.array(level(x * (101 + 5 * (k % 13)) / 100), level(x * (120 + 10 * (k % 7)) / 100))
    quoted = ad.table(spark, sf_dir, "part").select(
        k.alias("part"), x.alias("current_price"), F.when(k % 23 != 0, F.struct(low.alias("low"), (low + x * (k % 4) / 100).alias("high"))).alias("support"),
        F.struct(F.when(k % 17 == 0, 0.0).otherwise(x * (1 + k % 3) / 100).alias("atr14")).alias(f"f{op.TREND}"), F.when(k % 3 != 0, x * (200 + k % 5) / 200).alias("confirmation_level"),
        F.when(k % 19 != 0, levels).otherwise(F.slice(levels, 1, 0)).alias("resistances"), (k % 11 != 0).alias("long_allowed"), (60 + k % 40).alias("start_score"),
        (k % 5 == 0).alias("high_volatility"), F.lit(0.01).alias("tick_size"),
    )
    return op.price_plan(quoted).select("part", "plan_rejection", *[F.round(c, 4).alias(c) for c in PLAN_LEVELS])


@query("c25_plan_verdicts", oracle("SELECT coalesce(why, 'accepted') AS verdict, count(*) AS plans FROM pp3 GROUP BY 1", "pp3"))
def plan_verdicts(spark, sf_dir):
    return plans_of_parts(spark, sf_dir).groupBy(F.coalesce("plan_rejection", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("plans"))


@query("p23_tick_rounding", oracle(f"SELECT event_id, {DOWN('value * 1.2345')} AS down, {UP('value * 1.2345')} AS up FROM events"))
def tick_rounding(spark, sf_dir):
    price, tick = F.col("value") * 1.2345, F.lit(0.01)
    return ad.table(spark, sf_dir, "events").select(
        "event_id", op.round_down_tick(price, tick).alias("down"), op.round_up_tick(price, tick).alias("up")
    )
