"""Importance resampling and benchmark decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import DOCS, clashing, documents, folded, frame
from tidemark.llm import decontamination, importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def words_of(text):
    return WORD.findall(folded(text))


def runs(ws, longest):
    return [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def brute_resample(docs, target, longest=1, buckets=10_000):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for text in texts for f in runs(words_of(text), longest)) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text, *_ in docs:
        found = [gain(place(f)) for f in runs(words_of(text), longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranked = []
    for rank, r in enumerate(fit[: len(fit) * 10 // 100], 1):
        drawn[r] += 1
        ranked.append((*r[:4], rank))
    rest = Counter(rows) - drawn
    return ranked + [(*r[:4], None) for r in rest.elements()]


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_resample_equals_brute_force(spark, longest):
    rows = documents(n=300) + [(77, documents()[5][1], "en", "hot", 1)] * 40 + [(None, documents()[6][1], "en", "hot", 1)] * 3
    target = ["the and ing wh th the and", None, "", "eau qu " * 50, "über 12 the-ing \x00 é"]
    got = importance.resample(clashing(frame(spark, rows)), spark.createDataFrame(list(enumerate(target)), ITEMS), longest=longest)
    assert order(got.collect()) == order(brute_resample(rows, target, longest))


def test_resample_of_little(spark):
    items = spark.createDataFrame([(1, "a b c")], ITEMS)
    assert importance.resample(spark.createDataFrame([], DOCS), items).count() == 0
    few = frame(spark, documents()[-3:])
    assert order(importance.resample(few, items.limit(0)).collect()) == order(brute_resample(documents()[-3:], []))
    assert [r["rank"] for r in importance.resample(few, items, percent=100, least_words=0).orderBy("rank").collect()] == [1, 2, 3]


def test_checksums_of_spans():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 5, 39, 40, 41, 3000, 0, 7]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    assert importance.crc32_of(data, ends - [len(p) for p in parts], ends).tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_quickselect_finds_every_place(spark, k):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 5, rng.randrange(1000)]), rng.choice([None, 3, rng.randrange(9)]), 7, i) for i in range(1000)]
    keyed = spark.createDataFrame(rows, "score long, id long, tie long, row long").withColumn("key", importance.composite_key())
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))[k - 1]
    got = importance.kth_key(keyed, k)
    assert (-got["score"], got["id"], got["tie"], got["row"]) == want
    assert importance.kth_key(keyed, 1001) is None


def brute_hits(docs, items, window):
    known = {}
    for i, text in items:
        ws = words_of(text)
        n = min(window, len(ws))
        for a in range(len(ws) - n + 1 if n else 0):
            known.setdefault(tuple(ws[a : a + n]), set()).add(i)
    out = []
    for i, text, *_ in docs:
        ws, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in known}:
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in known:
                    hit.update(range(a, a + n))
                    found |= known[tuple(ws[a : a + n])]
        names = sorted(str(f) for f in found if f is not None)
        out.append((i, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize(("window", "part"), [(10, 200_000), (3, 200_000), (10, 60), (4, 40)])
def test_hits_equal_brute_force(spark, monkeypatch, window, part):
    monkeypatch.setattr(decontamination, "PART_WORDS", part)
    rows = documents(n=120)
    ws = [words_of(r[1]) for r in rows]
    long = ws[0] + ws[1]
    items = [(1, rows[10][1]), (2, " ".join(ws[20][3:20])), (2, rows[11][1]), (3, None), (4, "!!"), (None, " ".join(ws[30][:15])), (12, " ".join(ws[20][5:18])), (5, " ".join(long[:90]))]
    if window == 10:
        items += [(7, " ".join(ws[40][2:6])), (8, " ".join(ws[40][3:5])), (9, "a"), (21, rows[10][1])]
    rng = random.Random(window)
    letters = [(1000 + i, " ".join(rng.choice("abc") for _ in range(80)), "en", "s", 1) for i in range(60)]
    items += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(2, 14)))) for i in range(6)]
    rows = rows + letters
    found = decontamination.find(clashing(frame(spark, rows)), spark.createDataFrame(items, ITEMS), window)
    assert order(decontamination.digest(found, "doc_id").collect()) == order(brute_hits(rows, items, window))


def test_clean_takes_spans_out(spark):
    passage = "Zero, one - two! three four five six seven eight NINE"
    rows = [(1, f"é before. {passage}, after it all there is much more of the same text, so that it stays here", "en", "s", 1), (2, passage, "en", "s", 1), (3, "clean", "en", "s", 1), (4, None, "en", "s", 1)]
    items = spark.createDataFrame([(1, passage)], ITEMS)
    df = clashing(frame(spark, rows))
    got = decontamination.clean(df, items)
    assert got.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {1: "é before. , after it all there is much more of the same text, so that it stays here", 3: "clean", 4: None}
    assert {r["doc_id"] for r in decontamination.clean(df, items, most_words=10, most_share=1.0).filter("text like '%NINE%'").collect()} == {1, 2}
    assert decontamination.clean(df, items.limit(0)).exceptAll(df).count() == 0
    assert decontamination.find(df.limit(0), items).count() == 0
