"""Document quality by co-training two classifiers on separate views.

The text view sees the whole text's bytes, byte pairs, word lengths and repetition; the metadata
view sees source, language and length fields, never the text. Each view's logistic regression starts
from the labelled rows. In every round each view labels the pool rows it is surest of, in the
proportion of the labels, and hands them to the other view as examples. At the end each view is
calibrated on labelled rows kept apart, a last regression weighs the two calibrated log-odds, and
all documents are scored.

Training uses bounded samples, chosen by a hash of the identifier: ``LABELLED`` labelled documents
and a pool of ``POOL`` unlabelled ones. Scores, and the features of the samples, come from whole texts.

Defined results: a null text counts as empty; null metadata are values of their own. Rows with a
null identifier are scored but never learned from. A document with several labels has their mean, at
least one half meaning good; null labels are ignored. Without labels every score is 0.5; with labels
of one kind every score is their smoothed share. Repeated rows get the same score; where one identifier has
several texts, one of them is learned from, whichever comes first. Texts are read whole, however long. An empty
table gives an empty result. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import _FOLD, raw, words
from tidemark.llm.common import hash_sample

LABELLED, POOL = 6000, 6000
ROUNDS = 5
GIVEN = 200  # pseudo-labels a view hands over in a round
_PAIRS = 256
_KINDS = np.full(256, 6, np.uint8)  # other signs
_KINDS[ord("a") : ord("z") + 1] = 0
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
_KINDS[ord(" ")] = 3
_KINDS[[9, 10, 11, 12, 13]] = 4
_KINDS[128:] = 5
_SOURCES, _LANGS, _SIZES = 64, 16, 24
_SLICE = 512


def text_features(column: pa.Array) -> np.ndarray:
    data, offsets = raw(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    per = np.maximum(sizes, 1)[:, None]
    kinds = np.bincount(doc * 7 + _KINDS[data], minlength=n * 7).reshape(n, 7) / per
    folded = _FOLD[data].astype(np.int64)
    pair = (folded[:-1] * 167 + folded[1:]) % _PAIRS if len(folded) else folded
    inside = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    pairs = np.sqrt(np.bincount((doc[:-1] * _PAIRS + pair)[inside], minlength=n * _PAIRS).reshape(n, _PAIRS) / per)
    w = words(column)
    counts = w.counts()
    of = np.repeat(np.arange(n), counts)
    length = np.bincount(of, w.ends - w.starts, n) / np.maximum(counts, 1)
    codes, _ = pd.factorize(w.hashes() ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    fresh = np.zeros(len(codes), bool)
    fresh[np.unique(codes, return_index=True)[1]] = True
    distinct = np.bincount(of[fresh], minlength=n) / np.maximum(counts, 1)
    # A text of k words has fewer distinct ones the longer it is; the power law takes that out.
    spread = distinct * np.maximum(counts, 1) ** 0.15 / 2
    return np.concatenate([kinds, pairs, np.log1p(length)[:, None], distinct[:, None], spread[:, None]], axis=1)


def meta_features(source: np.ndarray, lang: np.ndarray, chars: np.ndarray) -> np.ndarray:
    n = len(source)
    out = np.zeros((n, _SOURCES + _LANGS + _SIZES + 1))
    rows = np.arange(n)
    out[rows, source] = 1
    out[rows, _SOURCES + lang] = 1
    size = np.log2(np.maximum(chars, 0) + 1.0)
    out[rows, _SOURCES + _LANGS + np.minimum(size, _SIZES - 1).astype(int)] = 1
    out[:, -1] = size / _SIZES
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight + self.bias, -30, 30)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, importance: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> Logistic:
        """Newton steps on the ridge-penalised likelihood."""
        w = np.ones(len(y)) if importance is None else importance
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        beta = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (w * (y - p)) - penalty * beta
            step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), grad)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, beta[:-1], float(beta[-1]))


@dataclass
class CoTrained:
    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        odds = np.stack([c.log_odds(v.log_odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta), strict=True)], axis=1)
        return 1 / (1 + np.exp(-np.concatenate([odds, self.combined.log_odds(odds)[:, None]], axis=1)))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
    apart = np.arange(len(y)) % 4 == 3  # rows arrive in hash order; these calibrate
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    own, share = ~apart, float(y.mean())
    taken: list[dict[int, float]] = [{}, {}]  # pool rows each view was given, with the label

    def fit(v: int) -> Logistic:
        rows = np.fromiter(taken[v], int, len(taken[v]))
        x = np.concatenate([labelled[v][own], pool[v][rows]])
        t = np.concatenate([y[own], np.fromiter(taken[v].values(), float, len(rows))])
        return Logistic.fit(x, t, np.concatenate([np.ones(own.sum()), np.full(len(rows), 0.5)]), ridge=4.0)

    views = [fit(0), fit(1)]
    for _ in range(rounds if len(pool[0]) else 0):
        for v in (0, 1):
            odds = views[v].log_odds(pool[v])
            order = np.argsort(odds, kind="stable")
            order = order[~np.isin(order, list(taken[1 - v]))]
            good, bad = round(given * share), given - round(given * share)
            sure = [(i, 1.0) for i in order[::-1][:good] if odds[i] > 2] + [(i, 0.0) for i in order[:bad] if odds[i] < -2]
            taken[1 - v].update(sure)
        views = [fit(0), fit(1)]
    at = apart if apart.any() else own
    calibrations = [Logistic.fit(views[v].log_odds(labelled[v][at])[:, None], y[at]) for v in (0, 1)]
    odds = np.stack([calibrations[v].log_odds(views[v].log_odds(labelled[v][at])[:, None]) for v in (0, 1)], axis=1)
    return CoTrained(views, calibrations, Logistic.fit(odds, y[at]))


def _coded(docs: DataFrame, ident: str, text: str, source: str, lang: str, chars: str) -> DataFrame:
    code = lambda c, n: F.pmod(F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(-1)), F.lit(n)).cast("int")
    return docs.select(
        F.col(ident).alias("id"), F.col(text).alias("text"), code(source, _SOURCES).alias("source"), code(lang, _LANGS).alias("lang"),
        F.coalesce(F.col(chars), F.lit(0)).cast("double").alias("chars"),
    )


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_features(batch.column("text")), meta_features(*(batch.column(c).to_numpy() for c in ("source", "lang", "chars")))


def _sampled(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Features and labels of the rows of a bounded sample, in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                text, meta = (x.astype(np.float32) for x in _features(batch))
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array([r.tobytes() for r in text]), pa.array([r.tobytes() for r in meta])], names=["h", "label", "text", "meta"])

    got = rows.mapInArrow(run, "h long, label double, text binary, meta binary").toArrow().to_pandas().sort_values(["h", "text"])
    stack = lambda c: np.stack([np.frombuffer(x, np.float32) for x in got[c]]).astype(float) if len(got) else np.zeros((0, 1))
    return (stack("text"), stack("meta")), got["label"].to_numpy(float)


def train(coded: DataFrame, labels: DataFrame, ident: str, label: str) -> CoTrained | float:
    """The trained pair of views, or the share of good labels where they are of one kind only."""
    known = labels.filter(F.col(ident).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(ident).alias("id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    ids = coded.select("id").filter("id IS NOT NULL").distinct()
    some = hash_sample(known.join(ids, "id"), "id", LABELLED)
    others = hash_sample(ids.join(known, "id", "left_anti"), "id", POOL).withColumn("label", F.lit(0.5))
    # Both samples are bounded, so the texts are not shuffled to find them.
    both = coded.join(F.broadcast(some.select("id", "h", "label").unionByName(others.select("id", "h", "label"))), "id").dropDuplicates(["id"])
    features, y = _sampled(both)
    has = y != 0.5
    if not has.any():
        return 0.5
    if len(set(y[has])) < 2:
        return float((y[has].sum() + 0.5) / (has.sum() + 1))
    return co_train(tuple(x[has] for x in features), y[has], tuple(x[~has] for x in features))


def classify(
    docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    chars: str = "n_chars", label: str = "quality",
) -> DataFrame:
    """Per row: identifier, ``text_score``, ``meta_score``, ``score`` and ``good`` (score at least one half)."""
    coded = _coded(docs, ident, text, source, lang, chars)
    model = train(coded, labels, ident, label)
    kind = dict(coded.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                s = np.full((batch.num_rows, 3), model) if isinstance(model, float) else model.scores(*_features(batch))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 2] >= 0.5)], names=["id", "text_score", "meta_score", "score", "good"])

    return coded.mapInArrow(run, f"id {kind}, text_score double, meta_score double, score double, good boolean").withColumnRenamed("id", ident)
