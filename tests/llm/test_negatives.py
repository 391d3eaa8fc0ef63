"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import clashing
from tidemark.llm import hard_negatives as hn

VECS = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    ok = [(i, n, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for n, (i, v, lab) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for ai, an, al, av in ok:
        if ai is None or ai % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i is None, i or 0, n, lab) for i, n, lab, v in ok if n != an)  # noqa: B905
        for ps, pabsent, pi, _, _ in [r for r in scored if r[4] == al][:positives]:
            fit = [r for r in scored if r[4] != al and 30 * -ps <= 100 * -r[0] <= 90 * -ps][:negatives]
            out += [(ai, None if pabsent else pi, k, None if a else i, -ps, -s) for k, (s, a, i, _, _) in enumerate(fit, 1)]
    return out


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def vectors(seed, n, width, kinds):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(kinds)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * 10, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(4)))
    return rows


def test_mined_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 40)
    monkeypatch.setattr(hn, "QUERIES", 3)
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "SAMPLE", 150)
    rows = vectors(1, 500, 6, 9) + [(20_000 + i, [1.0] * 6, i % 2) for i in range(200)]
    rows += [(30_000, None, 1), (30_100, [None] * 6, 1), (30_200, [float("nan")] * 6, 1), (30_300, [1.0] * 6, None), (30_400, [], 2), (30_500, [2.0, 1.0], 2),
             (None, [1.5] * 6, 1), (None, [1.5] * 6, 0), (100, [0.5] * 6, 1), (30_600, [float("inf")] * 6, 0), (2**60 * 100 // 100 + 24, [1.25] * 6, 1)]
    df = clashing(spark.createDataFrame(rows, VECS).repartition(4))
    same(hn.mine(df, lambda i: i % 100 == 0, F.col("label")), brute(rows))


def test_wide_range_of_values_uses_exact_integers(spark):
    rows = [(i * 50, [float(x) for x in np.random.default_rng(i).integers(-(2**20), 2**20, 5)], i % 3) for i in range(60)]
    same(hn.mine(spark.createDataFrame(rows, VECS), lambda i: i % 100 == 0, F.col("label")), brute(rows))


def test_little(spark):
    df = spark.createDataFrame(vectors(2, 12, 4, 2), VECS)
    for part in (df.limit(0), df.filter("vec_id = 0"), df.filter("vec_id = 10"), df.filter("vec_id in (0, 10)")):
        assert hn.mine(part, lambda i: i % 100 == 0, F.lit(1)).count() == 0


@pytest.mark.parametrize("same_label", [True, False])
def test_no_leaf_with_an_answer_is_eliminated(spark, same_label):
    rows = [(i, v, lab) for i, (_, v, lab) in enumerate(vectors(3, 3000, 8, 40))]
    staged = hn.staged(hn.vectors_of(spark.createDataFrame(rows, VECS), "vec_id", "embedding", F.col("label"), 256), "test")
    index, led, _ = hn.build(staged, 8)
    got = led.collect()
    leaf, label, m = np.array([r["leaf"] for r in got]), np.array([r["label"] for r in got]), hn.padded([r["v"] for r in got], 8)
    pick = np.arange(0, len(got), 60)
    scores = hn.products(m[pick], m)
    low, high = np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.985, axis=1)
    left = index.leaves(hn.Ask(m[pick], label[pick], low, high, same_label))
    for a in range(len(pick)):
        fit = (scores[a] >= low[a]) & (scores[a] <= high[a]) & ((label == label[pick[a]]) == same_label)
        assert left[a, np.unique(leaf[fit])].all()
    assert left.mean() < 0.7  # and some leaves are
