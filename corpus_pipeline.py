"""Corpus pipeline: language, exact copies, near copies, source mix and piece ids, one stage after another.

Every stage takes all that the stage before kept and returns the columns of documents, but for the
last, which adds the encoding. ``run`` writes each stage to the shared folder and reads it again.

Defined results: null texts and texts without letters go in the first stage, so do texts whose language
is open; without labelled rows every text goes. Of equal or linked documents the least identifier stays,
null ones last; repeated rows are copies of each other. Whole texts are read, however long. Extra columns
are carried by every stage, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, language_id, mixing, pieces
from tidemark.session import release, staged, staged_paths

#: Documents go when no language is this much likelier than an even share; of four languages one must reach 0.3.
LEAST_GAIN = 1.2


#: Rows of an Arrow batch.
BATCH = "1000"


#: Intermediate tables of operators that hold texts or sets; the others are small.
LARGE = ("content-sort", "jaccard-input", "shingle-sets", "rtree-blocks")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # what the last stage's operators staged


def stage(work: Stage) -> Stage:
    """Frees what the stage before has staged, once its result is written, which is when the next stage begins.

    Arrow batches hold whole texts, several times over and outside the heap, so the session gets small ones.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        release(spark, _left)
        before = staged_paths()
        out = work(spark, docs, sf_dir)
        _left[:] = [p for p in staged_paths() if p not in before and p.rsplit("/", 1)[-1].startswith(LARGE)]
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network tells; texts without letters and null texts go."""
    net = language_id.train(docs, "doc_id", "text", "lang")
    least = min(0.99, LEAST_GAIN / max(1, len(net.classes))) if net else 0.0
    return language_id.predict(docs, net).filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least)).select("row.*")


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the least identifier stays."""
    return exact_dedup.drop_duplicates(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents (five words, 0.8) the one with the least identifier stays."""
    return jaccard_join.keep_one_per_group(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; repeats are rows of their own."""
    mixed = mixing.mix(docs, carry=True).filter("copies > 0")
    return mixed.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


@stage
def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids, their number and whether they decode to the text."""
    done = pieces.encode(docs, pieces.PieceModel.load(), verify=True)
    return done.select("row.*", "piece_ids", F.size("piece_ids").alias("n_pieces"), "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("piece_ids", piece_ids),
]

#: The language, mix and piece stages are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for name, step in STAGES[:-1]:
        docs = staged(step(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, read)
        read = staged_paths()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
