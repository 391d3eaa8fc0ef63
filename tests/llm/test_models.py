"""Language, quality and language-model operators."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import DOCS, WORD, clashing, documents, folded, frame
from tidemark.llm import bytewords, cotraining, language_id, suffix_tree

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAZ éß\t\n\x0b\x1f\xa0x", max_size=30)), max_size=8))
def test_words_of_a_batch(texts):
    w = bytewords.words(pa.array(texts, pa.string()))
    want = [[x.encode() for x in WORD.findall(folded(t))] for t in texts]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert [w.word(i) for i in range(len(flat))] == flat
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(flat)) and len({(x, y) for x, y in zip(h.tolist(), flat, strict=True)}) == len(set(flat))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_language_edge_rows(spark):
    got = language_id.identify(clashing(frame(spark))).collect()
    assert len(got) == len(documents())
    texts = {r[0]: r[1] for r in documents() if r[0] is not None}
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            no_letter = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == no_letter
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert language_id.identify(spark.createDataFrame([], DOCS)).count() == 0
    unlabelled = [(1, "some text", None, None, None)]
    assert [tuple(r)[2:] for r in language_id.identify(frame(spark, unlabelled)).collect()] == [("und", 0.0)]


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 120)
    monkeypatch.setattr(language_id, "LEAST_EACH", 20)
    rows = [(i, "the and with this thing " * 8, "en", "hot", 1) for i in range(3000)] + [(5000 + i, "zxqj vkwz qqzx jjvk " * 8, "rare", "s", 1) for i in range(40)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(spark, rows)).filter("doc_id >= 4990 OR doc_id < 10").collect()}
    assert set(got.values()) == {"en", "rare"} and all(lang == ("rare" if i >= 5000 else "en") for i, lang in got.items())


def test_language_does_not_read_labels(spark):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in documents() if i is not None]
    net = language_id.train(frame(spark, rows), "doc_id", "text", "lang")
    a = {r["row"]["doc_id"]: r["score"] for r in language_id.predict(frame(spark, rows), net).collect()}
    b = {r["row"]["doc_id"]: r["score"] for r in language_id.predict(frame(spark, [(i, t, None, None, None) for i, t, *_ in rows]), net).collect()}
    assert a == b


def test_window_pooling_reads_every_byte(spark):
    net = language_id.ByteConvNet(["a", "b"])
    for f in net.filters:
        f[-1][ord("z")] += 50
    net.out *= 0.01
    scorer = language_id.Scorer(net)
    for n in (1, 508, 509, 510, 512, 513, 1018, 1021, 2000):
        data = np.random.default_rng(n).integers(97, 122, n).astype(np.uint8)
        data[data == ord("z")] = ord("y")
        changed = data.copy()
        changed[-1] = ord("z")
        assert not np.allclose(scorer.predict(data, np.array([0, n])), scorer.predict(changed, np.array([0, n])), atol=1e-4)


def test_quality_edges(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 0), (None, 1, 0), (5000, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(clashing(docs), labels).collect()
    assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in cotraining.classify(docs, labels.limit(0)).collect()} == {0.5}
    one = {r["score"] for r in cotraining.classify(docs, labels.filter("quality = 1")).collect()}
    assert len(one) == 1 and min(one) > 0.9
    assert cotraining.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_quality_of_rows_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = cotraining.classify(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    bad, good = ([r["score"] for r in got if r["quality"] == q] for q in (0, 1))
    assert sum(s >= 0.5 for s in good) >= 0.95 * len(good) and sum(s < 0.5 for s in bad) >= 0.8 * len(bad)


def test_lm_counts_and_base(spark):
    rows = documents()
    tokens, counts = [], Counter()
    for i, text, *_ in rows:
        own = [*WORD.findall(folded(text)), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        tokens.append((i, held, own))
        if not held:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6)) for i, held, own in tokens)
    out = suffix_tree.score(clashing(frame(spark))).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-4 * max(1, abs(w[5])) for g, w in zip(got, want, strict=True))
    assert all(r["score"] < 0 for r in out)
    assert suffix_tree.score(spark.createDataFrame([], DOCS)).count() == 0


def test_lm_tail_words_are_joined(spark, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in suffix_tree.score(frame(spark)).collect()}
    monkeypatch.setattr(suffix_tree, "HEAD", 3)
    tail = {(r["doc_id"], r["n_tokens"]): r["score"] for r in suffix_tree.score(frame(spark)).collect()}
    assert whole.keys() == tail.keys() and all(math.isclose(whole[k], tail[k], rel_tol=1e-9) for k in whole)


def test_suffix_tree_probabilities():
    """Against a plain recursion over the longest state, and summing to at most 1 over the symbols."""
    import pandas as pd

    rng = np.random.default_rng(3)
    deepest = Counter()
    for _ in range(400):
        ctx, sym = int(rng.integers(1, 4)) << 8 | int(rng.integers(1, 4)), int(rng.integers(0, 5))
        deepest[ctx, sym] += int(rng.integers(1, 9))
    counts = Counter()
    for (ctx, sym), n in deepest.items():
        for k in range(3):
            counts[k, ctx & ((1 << 8 * k) - 1), sym] += n
    held = pd.DataFrame([(k, c, s, n) for (k, c, s), n in counts.items() if k < 2 or c != 0x0202], columns=["k", "ctx", "sym", "n"])
    tree = suffix_tree.SuffixTree.fit(held, 2, 8)
    table = {(r.k, r.ctx, r.sym): r.n for r in held.itertuples()}

    def prob(ctx, sym, k):
        own = {s: n for (kk, c, s), n in table.items() if kk == k and c == ctx & ((1 << 8 * k) - 1)}
        if k == 0:
            below = sum(own.values()) + 0.5 * (len(own) + 1)
            return (own[sym] + 0.5) / below if sym in own else 0.5 / below / 256
        up = prob(ctx, sym, k - 1)
        return up if not own else (own.get(sym, 0) + len(own) * up) / (sum(own.values()) + len(own))

    for ctx in (0x0101, 0x0202, 0x0303, 0x0901, 0x0909):
        keys = np.array([ctx << 8 | s for s in range(256)], np.uint64)
        got = 10 ** tree.log10(keys)
        assert np.allclose(got, [prob(ctx, s, 2) for s in range(256)])
        assert got.sum() <= 1 + 1e-9


def test_lm_beats_base_on_held_out_texts(spark):
    out = suffix_tree.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").agg({"base_score": "sum", "score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_lm_trees_keep_one_threshold(spark, monkeypatch):
    """Trees above the bound of a broadcast are looked up by joins and score alike; none of their contexts goes."""
    score = lambda: sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in suffix_tree.score(frame(spark)).collect())
    whole = score()
    monkeypatch.setattr(suffix_tree, "MOST", 600)
    monkeypatch.setattr(suffix_tree, "HEAD", 300)
    tables = score()
    assert [x[:2] for x in whole] == [x[:2] for x in tables] and all(math.isclose(x[2], y[2], rel_tol=1e-9) for x, y in zip(whole, tables, strict=True))
