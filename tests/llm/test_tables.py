"""Mixing, shards, search and URL rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import DOCS, WORD, clashing, documents, frame
from tidemark.llm import mixing, sharding, topk_search, url_filter
from tidemark.llm.queries import RULES


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: limit * sizes[s] for s in over})
        left -= sum(limit * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix(spark):
    rows = documents(n=400)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    df = clashing(frame(spark, rows))
    got = mixing.mix(df, carry=True).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        source = r["row"]["source"]
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60), (s, taken[s], t)
    again = mixing.mix(frame(spark, rows).repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert {r["target"] for r in mixing.mix(frame(spark, [(1, None, "en", "a", 1), (2, " ", "en", None, 1)])).collect()} == {0.0}


def test_newton_meets_the_constraints(spark):
    hist = spark.createDataFrame([(False, s, size, n) for s in "ab" for size, n in ((1, 50), (10, 30), (200, 5), (5000, 1))], "absent boolean, source string, size long, n long")
    total = sum(size * n for size, n in ((1, 50), (10, 30), (200, 5), (5000, 1)))
    targets = spark.createDataFrame([(False, "a", total, 0.4 * total), (False, "b", total, 1.7 * total)], "absent boolean, source string, source_size long, target double")
    for r in mixing.multipliers(hist, targets, 2.0).collect():
        words = sum(n * size * min(2.0, np.exp(min(700, r["lam"] * size / r["mean"]))) for size, n in ((1, 50), (10, 30), (200, 5), (5000, 1)))
        assert words == pytest.approx(r["target"], rel=1e-6)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(spark, shards):
    rows = documents(n=600) + [(5000 + i, "copy of one text", "en", "s", 16) for i in range(2500)]
    rows = [r for r in rows if r[0] not in (905, 907)]
    dims = {"bytes": F.octet_length("text"), "n_chars": F.col("n_chars"), "lang": F.crc32("lang")}
    got = sharding.kd_shards(clashing(frame(spark, rows)), shards, dims=dims).collect()
    assert len(got) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None
    assert set(sizes) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert max(abs(s - mean) for s in sizes.values()) <= 0.03 * mean + 1000


def test_shards_of_little(spark):
    assert sharding.kd_shards(spark.createDataFrame([], DOCS), 16).count() == 0
    got = sharding.kd_shards(frame(spark, documents()[-3:]), 16).collect()
    assert len(got) == 3 and all(0 <= r["shard"] < 16 for r in got)


VECS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=20):
    ok = [(i, n, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for n, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, qn, q in ok:
        if qi is not None and qi % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), (i is None, i or 0)) for i, n, c in ok if n != qn)  # noqa: B905
            out += [(qi, r + 1, i[1] if not i[0] else None, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)], 0) for i in range(130)]
    rows += [(200 + i, rows[0][1], 0) for i in range(60)] + [
        (300, None, 0), (320, [None, 1.0], 0), (340, [float("nan")] * 6, 0), (360, [float("inf")] * 6, 0), (380, [], 0), (None, rows[1][1], 0), (400, [0.5, 0.25], 0), (20, rows[2][1], 0)]
    df = spark.createDataFrame(rows, VECS).repartition(4)
    got = topk_search.top_k(df, F.col("id") % 20 == 0, 20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute_top(rows), key=str)
    assert topk_search.top_k(spark.createDataFrame([], VECS), F.col("id") % 20 == 0, 20).count() == 0
    assert topk_search.top_k(df.filter("vec_id = 1"), F.col("id") % 20 == 0, 20).count() == 0
    few = topk_search.top_k(df.filter("vec_id in (0, 1, 3)"), F.col("id") % 20 == 0, 20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 7)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], 0) for i in range(101)]
    got = topk_search.top_k(spark.createDataFrame(rows, VECS).repartition(3), F.col("id") % 20 == 0, 20)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows))


def brute_verdict(url, rules):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["example.com", "a.example.com", "notexample.com", "com", "net", "x.example.net", "y.org", "org", "EXAMPLE.Com", "example.com:80", "", "..com", "com."]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=/de/", "/de/8#/es/", "/de/", "/es/9", "//en/", "/EN/", "/en"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "ftp://u@", "", "://") for h in hosts for p in paths] + [None, "", "x://y://com/en/", "http://com?/en/", "http://com/en/\nz"]
    rules = RULES + [("block", f"h{i}.net", f"/p{rng.randint(0, 9)}") for i in range(200)]
    urls += [f"http://h{rng.randint(0, 300)}.net/p{rng.randint(0, 9)}/{i}" for i in range(2000)]
    df = clashing(spark.createDataFrame(list(enumerate(urls)) + [(None, "http://com/en/")] * 2, "page_id long, url string"))
    for chosen in (RULES, rules, []):
        got = url_filter.judge(df, chosen).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            assert tuple(r)[1:] == brute_verdict(urls[r["page_id"]] if r["page_id"] is not None else "http://com/en/", chosen), r
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.build(df, [("allow", "a", "/"), ("block", "a", "/")])


def test_cascade_is_exact_over_its_universe():
    rng = random.Random(8)
    universe = [f"k{rng.random()}" for _ in range(20_000)]
    listed = set(universe[:700])
    first = url_filter.Bloom(listed, 0.3, 0)
    cascade = url_filter.finish_cascade(first, listed, {k for k in universe[700:] if k in first})
    assert len(cascade.levels) > 3 and all((k in cascade) == (k in listed) for k in universe)
