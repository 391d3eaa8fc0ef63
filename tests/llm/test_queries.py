"""Registered queries next to their SQL, and the pipeline next to a brute-force version."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.data import DOCS, WORD, clashing, documents, folded, frame
from tests.llm.test_copies import brute_groups
from tests.llm.test_tables import brute_targets
from tidemark.llm import language_id
from tidemark.llm.queries import QUERIES
from tidemark.session import shared_dir, staged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    from tools.check_queries import duck, rows_of

    run, sql = QUERIES[name]
    df = run(spark, SF)
    cur = duck(SF).execute(sql)
    assert rows_of((df.columns, [tuple(r) for r in df.collect()])) == rows_of(([d[0] for d in cur.description], cur.fetchall()))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_runs_over_every_document(spark, name):
    got = QUERIES[name][0](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_jaccard_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in QUERIES["op2_jaccard_join"][0](spark, SF).collect())
    assert sorted(got, key=str) == sorted(brute_groups(rows), key=str)


def test_pipeline_stages_against_brute_force(spark):
    where = shared_dir(spark, "pipeline-input")
    spark.createDataFrame(documents(n=150), DOCS).write.parquet(f"{where}/documents.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, where).write.parquet(out)
        after_df = spark.read.parquet(out)
        after = [tuple(r) for r in after_df.collect()]
        if k < 4:
            assert after_df.columns == docs.columns
        ids = sorted((str(r[0]) for r in after), key=str)
        if name == "language":
            assert ids == sorted(str(r[0]) for r in before if any(c.isalpha() for c in r[1] or ""))
        elif name == "exact_copies":
            groups = defaultdict(list)
            for r in before:
                groups[folded(r[1])].append(r[0])
            assert ids == sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
        elif name == "near_copies":
            kept = {c for _, n, c in brute_groups(before) if n}
            assert ids == sorted(map(str, kept))
        elif name == "source_mix":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r[3]] += len(WORD.findall(r[1]))
            for r in after:
                taken[r[3]] += len(WORD.findall(r[1]))
            for s, t in brute_targets(sizes).items():
                # Copies are whole: a very long document moves a source by its length.
                longest = max(len(WORD.findall(r[1])) for r in before if r[3] == s)
                assert abs(taken[s] - t) <= max(0.02 * t, 60, longest / 2)
            assert set(after) <= set(before) and max(after.count(r) for r in random.Random(1).sample(after, 20)) <= 2
        else:
            assert len(after) == len(before) and all(r["round_trip"] for r in after_df.collect())
        docs = after_df


@pytest.mark.parametrize("classes", [1, 2, 4, 20])
def test_open_languages_are_rejected(spark, monkeypatch, classes):
    net = language_id.ByteConvNet([f"l{i}" for i in range(classes)])
    net.out[:] = 0
    monkeypatch.setattr(corpus_pipeline.language_id, "train", lambda *_: net)
    docs = spark.createDataFrame([(1, "some words", None, "s", 1)], DOCS)
    assert corpus_pipeline.language(spark, docs, "").count() == (classes == 1)  # every language is as likely as another
    net.out_bias[0] = 1.0
    assert corpus_pipeline.language(spark, docs, "").count() == 1


def test_pipeline_carries_columns_with_clashing_names(spark):
    df = clashing(frame(spark, documents(n=40)))
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, df, "")
        assert after.columns == df.columns
        df = staged(after, "clashing")
    assert df.count() > 0 and {r["comp"] for r in df.select("comp").collect()} == {"own comp"}


def test_pipeline_of_nothing(spark):
    where = shared_dir(spark, "pipeline-empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{where}/documents.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0
