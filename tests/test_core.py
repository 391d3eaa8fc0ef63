"""Join helpers, order statistics and smoothers against brute force, hot keys included."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timecol import HOUR, MINUTE
from tidemark.operators import bars as br, smoothing as sm
from tidemark.operators.joins import asof_backward, first_in_lookback, interval_join, previous_row
from tidemark.operators.order_stats import grouped_median, pool_percentile, top_n_per_group
from tidemark.operators.ranks import rank_rows
from tidemark.operators.series import number_rows
from tidemark.sources.adapters import TEST_FRAMES

RNG = random.Random(7)


def points(n, hot=0.4, span=400):
    """(key, minute, id): one key holds a large share and times repeat."""
    out = []
    for i in range(n):
        key = "hot" if RNG.random() < hot else f"k{RNG.randrange(5)}"
        out.append((key, RNG.randrange(span), i))
    return out


def frame(spark, rows, *names):
    df = spark.createDataFrame(rows, ["key", "minute", "id"])
    return df.select("key", F.timestamp_micros(F.col("minute") * MINUTE).alias("t"), "id", *names)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_brute_force(spark, strict):
    left, right = points(300), points(200)
    got = asof_backward(
        frame(spark, left), frame(spark, right), ["key"], "t", "t", ["id"], "id", strict=strict, bucket=HOUR
    ).collect()
    for row in got:
        minute = int(row["t"].timestamp() // 60)
        hits = [r for r in right if r[0] == row["key"] and (r[1] < minute if strict else r[1] <= minute)]
        want = max(hits, key=lambda r: (r[1], r[2]))[2] if hits else None
        assert (row["asof"]["id"] if row["asof"] else None) == want
    assert len(got) == len(left)


def test_previous_row_crosses_buckets(spark):
    rows = points(200, span=5000)
    got = previous_row(frame(spark, rows), ["key"], ["t", "id"], ["id"], F.floor(F.unix_micros("t") / HOUR)).collect()
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        before = {b[2]: (a[2] if a else None) for a, b in zip([None, *ordered], ordered)}
        for row in (g for g in got if g["key"] == key):
            assert (row["previous"]["id"] if row["previous"] else None) == before[row["id"]]


def test_lookback_and_interval_join(spark):
    rows = points(200, span=600)
    got = first_in_lookback(frame(spark, rows), ["key"], "t", "id", ["id"], 30 * MINUTE, HOUR).collect()
    for row in got:
        minute = int(row["t"].timestamp() // 60)
        hits = [r for r in rows if r[0] == row["key"] and minute - 30 <= r[1] < minute]
        assert (row["earlier"]["id"] if row["earlier"] else None) == (min(hits, key=lambda r: (r[1], r[2]))[2] if hits else None)
    spans = frame(spark, points(40, span=600)).select("key", F.col("id").alias("span"), F.col("t").alias("a"), (F.col("t") + F.expr("INTERVAL 3 HOURS")).alias("b"))
    pairs = interval_join(spans, frame(spark, rows), ["key"], "a", "b", "t")
    plain = spans.join(frame(spark, rows), "key").filter("t BETWEEN a AND b")
    assert sorted(map(tuple, pairs.select("span", "id").collect())) == sorted(map(tuple, plain.select("span", "id").collect()))


def test_median_and_percentile_are_exact(spark):
    rows = [("hot", RNG.choice([0.0, -1.5, 3.25, RNG.gauss(0, 1e6), RNG.gauss(0, 1e-7)])) for _ in range(601)]
    rows += [("two", 1.0), ("two", 2.0), ("one", -4.0), ("tie", 5.0), ("tie", 5.0), ("tie", 5.0), ("nul", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    got = {r["key"]: r["median"] for r in grouped_median(df, ["key"], "v").collect()}
    for key in ("hot", "two", "one", "tie"):
        assert got[key] == statistics.median(v for k, v in rows if k == key)
    assert "nul" not in got
    known = df.filter("v IS NOT NULL")
    for row in pool_percentile(known, ["key"], "v", "p").collect():
        pool = [v for k, v in rows if k == row["key"] and v is not None]
        want = 100.0 if len(pool) <= 1 else sum(x < row["v"] for x in pool) / (len(pool) - 1) * 100
        assert row["p"] == pytest.approx(want)


def test_top_n_in_two_rounds(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") * 37 % 101).alias("s"))
    got = top_n_per_group(df, ["g"], [F.col("s").desc(), F.col("id")], 25, 25, F.col("id"), salts=8)
    want = sorted(((r["g"], r["s"], r["id"]) for r in df.collect()), key=lambda r: (-r[1], r[2]))
    for g in (0, 1):
        assert {r["id"] for r in got.filter(F.col("g") == g).collect()} == {r[2] for r in [w for w in want if w[0] == g][:25]}


def reference_series(closes, highs, lows):
    """Sequential indicators of one series, written out step by step."""

    def ema(values, p, start=0):
        out = [0.0] * len(values)
        for i in range(len(values)):
            if i == start + p - 1:
                out[i] = sum(values[start:i + 1]) / p
            elif i >= start + p:
                out[i] = 2 / (p + 1) * values[i] + (1 - 2 / (p + 1)) * out[i - 1]
        return out

    fast, slow = ema(closes, 12), ema(closes, 26)
    line = [fast[i] - slow[i] if i >= 25 else 0.0 for i in range(len(closes))]
    signal = ema(line, 9, 25)
    gain = loss = None
    rsi, atr, tr = [], [], []
    for i, c in enumerate(closes):
        prev = closes[i - 1] if i else None
        tr.append(highs[i] - lows[i] if prev is None else max(highs[i] - lows[i], abs(highs[i] - prev), abs(lows[i] - prev)))
        atr.append(0.0 if i < 13 else sum(tr[:14]) / 14 if i == 13 else (atr[-1] * 13 + tr[i]) / 14)
        if i < 14:
            rsi.append(0.0)
            continue
        steps = [closes[j] - closes[j - 1] for j in range(1, i + 1)]
        if i == 14:
            gain, loss = sum(max(s, 0) for s in steps) / 14, sum(max(-s, 0) for s in steps) / 14
        else:
            gain, loss = (gain * 13 + max(steps[-1], 0)) / 14, (loss * 13 + max(-steps[-1], 0)) / 14
        rsi.append(50.0 if gain == loss == 0 else 100.0 if loss == 0 else 0.0 if gain == 0 else 100 - 100 / (1 + gain / loss))
    return {"ema20": ema(closes, 20), "ema200": ema(closes, 200), "macd": line, "macd_signal": signal, "rsi14": rsi, "atr14": atr}


def bars_frame(spark, closes, instrument="A", timeframe="1H", open_tail=0):
    n = len(closes)
    rows = [(instrument, timeframe, i, float(c), float(c) + 1, float(c) - 1, 100.0 + i, i < n - open_tail) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "instrument_id string, timeframe string, i bigint, close double, high double, low double, volume_quote double, confirmed boolean")
    return df.withColumn("open_time", F.timestamp_micros(F.col("i") * HOUR)).withColumn("close_time", F.timestamp_micros((F.col("i") + 1) * HOUR)).withColumn("open", F.col("close")).withColumn("volume_base", F.lit(1.0)).drop("i")


@pytest.mark.parametrize("shape", ["walk", "flat", "up", "down"])
def test_chunked_smoothers_equal_the_sequential_ones(spark, shape):
    closes = {"walk": [100 + 10 * RNG.random() + i / 50 for i in range(700)], "flat": [100.0] * 700,
              "up": [100.0 + i for i in range(700)], "down": [900.0 - i for i in range(700)]}[shape]
    want = reference_series(closes, [c + 1 for c in closes], [c - 1 for c in closes])
    numbered = number_rows(bars_frame(spark, closes), ["instrument_id", "timeframe"], ["open_time"], F.floor(F.unix_micros("open_time") / (50 * HOUR)))
    got = {r["idx"]: r for r in sm.indicators(numbered, ["instrument_id", "timeframe"], chunk=256).collect()}
    assert sorted(got) == list(range(700))
    for name, values in want.items():
        for i, v in enumerate(values):
            assert got[i][name] == pytest.approx(v, abs=1e-7), (name, i)


def test_short_fold_equals_full_history_form(spark):
    closes = [100 + 10 * RNG.random() for _ in range(120)]
    bars = bars_frame(spark, closes, open_tail=1)
    want = reference_series(closes[:-1], [c + 1 for c in closes[:-1]], [c - 1 for c in closes[:-1]])
    row = br.frame_readings(bars).collect()[0]
    for mine, theirs in (("ema20", "ema20"), ("rsi14", "rsi14"), ("atr14", "atr14")):
        assert row[mine] == pytest.approx(want[theirs][-1], abs=1e-9)
    assert row["macd_histogram"] == pytest.approx(want["macd"][-1] - want["macd_signal"][-1], abs=1e-9)
    assert row["rsi_10"] == pytest.approx(want["rsi14"][-11], abs=1e-9)
    assert row["volume_median20"] == statistics.median(100.0 + i for i in range(99, 119))
    assert row["latest_confirmed"] is False and row["latest_close"] == closes[-1] and row["last_close"] == closes[-2]


def test_too_short_or_invalid_series_are_left_out(spark):
    short = bars_frame(spark, [100.0] * 49, "S")
    bad = bars_frame(spark, [100.0] * 60, "B").withColumn("low", F.when(F.col("open_time") == F.timestamp_micros(F.lit(5 * HOUR)), 101.0).otherwise(F.col("low")))
    good = bars_frame(spark, [100.0] * 60, "G")
    assert [r["instrument_id"] for r in br.frame_readings(short.unionByName(bad).unionByName(good)).collect()] == ["G"]


def test_frames_are_multiples():
    assert all(w % min(TEST_FRAMES.values()) == 0 for w in TEST_FRAMES.values())


def test_numbers_over_partitions(spark):
    rows = [(c, i % 50, i) for c in ("a", "b", None) for i in range(700 if c == "a" else 3)]
    df = spark.createDataFrame(rows, "c string, v int, i int").repartition(5)
    got = rank_rows(df, [F.desc("v"), F.asc("i")], within=["c"]).collect()
    want = {}
    for c in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2])), 1):
            want[r] = n
    assert {(r["c"], r["v"], r["i"]): r["rank"] for r in got} == want and len(got) == len(rows)
    assert sorted(r["rank"] for r in rank_rows(df, [F.asc("i"), F.asc("c")]).collect()) == list(range(1, len(rows) + 1))
    assert rank_rows(df.limit(0), [F.asc("i")]).count() == 0


def test_range_summaries_equal_brute_force(spark):
    from tidemark.operators.pyramid import covering_blocks, range_summaries

    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 3}", rng.randrange(0, 5000), i if rng.random() < 0.9 else rng.randrange(600), rng.uniform(-5, 5)) for i in range(600)]
    points = spark.createDataFrame(rows, "key string, m long, id long, v double").withColumn("t", F.timestamp_micros(F.col("m") * MINUTE)).drop("m")
    asked = sorted({(rng.choice(["hot", "k0", "k1", "none"]), a, a + rng.choice([0, 1, 14, 15, 16, 700, 4000]), rng.randrange(-1, 600)) for a in (rng.randrange(0, 4500) for _ in range(150))})
    ranges = spark.createDataFrame(asked, "key string, a long, b long, after long").withColumns({"start": F.timestamp_micros(F.col("a") * MINUTE), "end": F.timestamp_micros(F.col("b") * MINUTE)})
    got = range_summaries(ranges, points, ["key"], "start", "end", "after", "t", "v", "id", base=15 * MINUTE, levels=5)
    found = {(r["key"], r["start"], r["end"], r["after"]): (r["n"], r["least"], r["greatest"]) for r in got.collect()}
    times = {(r["key"], r["a"], r["b"], r["after"]): (r["start"], r["end"]) for r in ranges.collect()}
    some = 0
    for key, a, b, after in asked:
        inside = [v for k, m, i, v in rows if k == key and a < m <= b and i > after]
        want = (len(inside), min(inside), max(inside)) if inside else None
        assert found.get((key, *times[key, a, b, after], after)) == want
        some += want is not None
    assert some > 30 and len(found) == some
    blocks = spark.createDataFrame([(a, b) for a in range(0, 40) for b in range(a, 41)], "a long, b long").select("a", "b", covering_blocks(F.col("a"), F.col("b"), 4).alias("c")).collect()
    for r in blocks:
        assert sorted(x for c in r["c"] for x in range(c["block"] << c["level"], (c["block"] + 1) << c["level"])) == list(range(r["a"], r["b"]))
        assert sum(c["level"] < 3 for c in r["c"]) <= 6
