"""Exact duplicates and similar groups against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import DOCS, WORD, clashing, documents, folded, frame
from tidemark.llm import common, exact_dedup, jaccard_join


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(spark, keep):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[folded(r[1])].append(r[0])
    got = exact_dedup.duplicate_report(frame(spark), keep=keep).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert set(kept) == set(digest) and set(kept.values()) == {1}
    for r in got:
        ids = [i for i in digest[r["text_sha256"]] if i is not None]
        best = (min(ids) if keep == "smallest" else max(ids)) if ids else None
        assert r["keep_id"] == best and r["group_size"] == len(digest[r["text_sha256"]])
        assert not r["kept"] or r["doc_id"] == best


def test_exact_copies_keep_columns_and_span_partitions(spark):
    rows = [(i, "same text", "en", "s", 9) for i in range(500)] + [(1000 + i, f"text {i}", "en", "s", 9) for i in range(20)]
    df = clashing(frame(spark, rows))
    out = exact_dedup.drop_duplicates(df.repartition(7))
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0] + [1000 + i for i in range(20)]
    report = exact_dedup.duplicate_report(df, keep="largest")
    assert {(r["keep_id"], r["group_size"]) for r in report.filter("group_size > 1").collect()} == {(499, 500)}


def test_exact_copies_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.duplicate_report(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def brute_groups(rows, percent=80, width=5):
    sets = []
    for r in rows:
        words = WORD.findall(folded(r[1]))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)].append(r[0])
    return sorted((str(r[0]), len(sets[i]), min(least[top(i)], default=None)) for i, r in enumerate(rows))


def similar(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df).collect())


def key(rows):
    return sorted(rows, key=str)


def test_similar_groups(spark):
    assert key(similar(frame(spark))) == key(brute_groups(documents()))


def test_chains_are_found_by_descent(spark, monkeypatch):
    """A chain of texts, each similar to the next only, with an element order that makes all of them common."""
    monkeypatch.setattr(jaccard_join, "PACKINGS", 1)
    monkeypatch.setattr(jaccard_join, "LEAST_COMMON", 2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 120]), "en", "s", 1) for i in range(40)] + [(100 + i, " ".join(words[i * 40 : i * 40 + 120]), "en", "s", 1) for i in range(7)]
    assert key(similar(frame(spark, rows))) == key(brute_groups(rows))


def test_the_middle_of_a_group_leads(spark, monkeypatch):
    """Copies that are each similar to one text in their midst, but not to each other, are not compared pair by pair."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for j, at in enumerate(draw.sample(range(5, 195), 3) if i != 70 else ()):
            words[at] = f"x{i}_{j}"
        rows.append((i, " ".join(words), "en", "s", 1))
    compared, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, sets, percent: compared.append(pairs.count()) or links(pairs, sets, percent))
    assert key(similar(frame(spark, rows))) == key(brute_groups(rows))
    assert sum(compared) < 10 * len(rows)


def test_one_of_each_group_stays(spark):
    df = clashing(frame(spark))
    out = jaccard_join.keep_one_per_group(df)
    assert out.columns == df.columns
    want = {c for _, n, c in brute_groups(documents()) if n and c is not None}
    got = [r["doc_id"] for r in out.collect()]
    assert want <= set(got)
    sizes = {i: n for i, n, _ in brute_groups(documents())}
    assert all(i is None or i in want or sizes[str(i)] == 0 for i in got) and got.count(910) + got.count(None) <= 2
    empty = spark.createDataFrame([], DOCS)
    assert jaccard_join.similar_groups(empty).count() == 0 and jaccard_join.keep_one_per_group(empty).count() == 0


def test_tables_with_fewer_words_than_a_shingle(spark):
    for n in range(1, 6):
        text = " ".join(f"w{i}" for i in range(n))
        rows = [(1, text, "en", "s", n), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
        assert key(similar(spark.createDataFrame(rows, DOCS).coalesce(1))) == key(brute_groups(rows))
    hashes = [jaccard_join._shingles(pa.array([" ".join("abcd"[:n])]), 5)[0].tolist() for n in range(1, 5)]
    beside = jaccard_join._shingles(pa.array([*(" ".join("abcd"[:n]) for n in range(1, 5)), "a b c d e f g"]), 5)[0].tolist()
    assert sum(hashes, []) == beside[:4]  # short texts hash alike beside longer ones


def brute_links(rows, percent=80, width=5):
    sets = []
    for r in rows:
        words = WORD.findall(folded(r[1]))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    linked = [[bool(a & b) and 100 * len(a & b) >= percent * len(a | b) for b in sets] for a in sets]
    return sorted((str(r[0]), sum(linked[i]) - linked[i][i]) for i, r in enumerate(rows))


def test_links_of_every_row(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(150)]
    rows = documents() + [(2000 + i, " ".join(w if rng.random() > 0.02 else f"new{i}" for w in base), "en", "s", 1) for i in range(25) for _ in range(1 + i % 3)]
    rows += [(3000 + i, " ".join(f"w{k}" for k in range(i * 6, i * 6 + 120)), "en", "s", 1) for i in range(12)]
    for page in (jaccard_join.PAGE, 4):
        monkeypatch.setattr(jaccard_join, "PAGE", page)
        got = sorted((str(r["doc_id"]), r["n_links"]) for r in jaccard_join.similar_groups(clashing(frame(spark, rows))).collect())
        assert got == brute_links(rows)
    assert any(n > 20 for _, n in got)


def test_fine_points_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for n, m, both in ((40, 50, 40), (2000, 2000, 0), (2000, 1700, 1600), (3000, 3700, 100), (70, 70, 0), (1, 1, 1)):
        x, y = (rng.integers(0, 1 << 48, k, dtype=np.uint64) for k in (n, m))
        y[:both] = x[:both]
        most = jaccard_join._fine_bound(jaccard_join._fine_point(x), jaccard_join._fine_point(y))
        assert both <= most <= min(n, m)
        if n > 1000 and both < 1000:  # the bound of few coordinates lets such pairs through
            assert most < jaccard_join._asked(n, m, 80)
    full = np.arange(100, dtype=np.uint64) * np.uint64(1 << 20)  # all in one group
    assert jaccard_join._fine_bound(jaccard_join._fine_point(full), jaccard_join._fine_point(full)) is None


def test_long_texts_alike_by_chance_are_not_verified(spark, monkeypatch):
    """Long texts share a passage; their counts by few groups are alike, but no whole set is shuffled for them."""
    draw = random.Random(8)
    start = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(start + [f"x{draw.random()}" for _ in range(4000)]), "en", "s", 1) for i in range(12)]
    rows += [(100 + i, rows[i][1] + " and more", "en", "s", 1) for i in range(4)]
    bounded, verified = [], []
    fine = jaccard_join._finely_bounded

    def counted(pairs, sets, percent):
        out = fine(pairs, sets, percent)
        bounded.append(pairs.count())
        verified.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_finely_bounded", counted)
    assert key(similar(frame(spark, rows))) == key(brute_groups(rows))
    assert sum(bounded) > 8 and sum(verified) == 4


def test_tasks_give_freed_memory_back(monkeypatch):
    trimmed = []
    monkeypatch.setattr(common, "_trim", lambda: trimmed.append(True))
    assert list(common.giving_back(lambda batches: (b for b in batches))(iter([1, 2]))) == [1, 2] and trimmed == [True]
    assert jaccard_join._BATCH * 2 * 12_000 < 8_000_000  # a batch of two long sets each
