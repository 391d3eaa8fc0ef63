"""Language identification by a small byte convolutional network.

Filters of widths 2, 3 and 4 slide over the folded bytes of fixed-length windows; the greatest
response of each filter in a window goes through a softmax layer. The network is trained in numpy on
the driver from a bounded sample of labelled windows, one of each chosen document: ``SAMPLE`` in all, dealt
evenly to the languages and at least ``LEAST_EACH`` of each, by a hash of the identifier, so that a rare
language is learned and a hot source takes no other's share. Prediction runs over every window of every text: windows overlap by
one byte less than the widest filter, so no byte sequence is cut, and a document's windows are
averaged by their length.

Defined results: a null text, or one without a letter, gives ``und`` with score 0. Without labelled
rows every text is ``und``; with one language in the labels every text with letters gets it. Texts of any length
are read whole; memory is bounded by the window batch. Rows with a null identifier are never learned from.
Equally likely languages go to the first by name. Repeated rows are predicted alike, each in its own row. An
empty table gives an empty result. Extra columns are carried by ``predict``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytewords import _FOLD, raw
from tidemark.llm.common import giving_back

SAMPLE = 6000  # windows learned from, dealt evenly to the languages
LEAST_EACH = 50  # but as many of each language
WINDOW = 512
FILTERS = 8
WIDTHS = (2, 3, 4)
_EXTRA = max(WIDTHS) - 1  # empty bytes behind a window, so that every filter can start at each of its bytes
_STRIDE = WINDOW - _EXTRA
UNKNOWN = "und"


def _windows(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), WINDOW + _EXTRA), dtype=np.uint8)
    for i, t in enumerate(texts):
        out[i, : min(len(t), WINDOW)] = _FOLD[np.frombuffer(t[:WINDOW], np.uint8)]
    return out


class ByteConvNet:
    """Parameters and training of the network."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, places = [], []
        for f, w in zip(self.filters, WIDTHS, strict=True):
            r = sum(f[k][x[:, k : k + WINDOW]] for k in range(w))
            at = r.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(tops, axis=1), places

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on the cross-entropy; windows are shown whole and cut short in turn, so short texts are learned too."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                xb = x[pick].copy()
                short = rng.random(len(pick)) < 0.4
                keep = np.where(short, rng.integers(8, 120, len(pick)), WINDOW)
                xb[np.arange(WINDOW + _EXTRA)[None, :] >= keep[:, None]] = 0
                top, places = self._pool(xb)
                hidden = np.maximum(top + self.bias, 0)
                logits = hidden @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p /= len(pick)
                d_hidden = (p @ self.out.T) * (hidden > 0)
                grads = []
                for j, (f, w) in enumerate(zip(self.filters, WIDTHS, strict=True)):
                    g, d = np.zeros_like(f), d_hidden[:, j * FILTERS : (j + 1) * FILTERS]
                    for k in range(w):
                        seen = np.take_along_axis(xb, places[j] + k, axis=1)
                        np.add.at(g[k], (seen, np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
                grads += [d_hidden.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                t += 1
                for i, (param, g) in enumerate(zip(params, grads, strict=True)):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    param -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter responses by byte pair: what starts at a pair for all widths, and the ends of widths 3 and 4."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1), three[2].copy(), pair(four[2], four[3])


class Scorer:
    """Predicts texts with a trained network."""

    def __init__(self, net: ByteConvNet):
        self.net = net
        self.start, self.end3, self.end4 = net.tables()

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
        n = WINDOW
        r = self.start[pairs[:, :n]]
        r[:, :, FILTERS : 2 * FILTERS] += self.end3[x[:, 2 : 2 + n]]
        r[:, :, 2 * FILTERS :] += self.end4[pairs[:, 2 : 2 + n]]
        hidden = np.maximum(r.max(axis=1) + self.net.bias, 0)
        logits = hidden @ self.net.out + self.net.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, data: np.ndarray, offsets: np.ndarray, batch: int = 128) -> np.ndarray:
        """Class probabilities of every text in the buffer."""
        sizes = np.diff(offsets)
        counts = np.maximum(1, -(-np.maximum(sizes - (WINDOW - _STRIDE), 1) // _STRIDE))
        doc = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = offsets[:-1][doc] + nth * _STRIDE
        length = np.minimum(offsets[1:][doc] - begin, WINDOW)
        total = np.zeros((len(sizes), len(self.net.classes)))
        padded = np.concatenate([data, np.zeros(WINDOW + _EXTRA, np.uint8)])
        steps = np.arange(WINDOW + _EXTRA)
        for at in range(0, len(doc), batch):
            part = slice(at, at + batch)
            x = _FOLD[padded[begin[part, None] + steps]]
            x[steps[None, :] >= length[part, None]] = 0
            np.add.at(total, doc[part], self.log_probs(x) * length[part, None])
        total /= np.maximum(sizes, 1)[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def _in_fold(ident: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(ident).cast("string")), F.lit(folds)) == fold


def train(docs: DataFrame, ident: str, text: str, lang: str, folds: int = 5, fold: int = 0) -> ByteConvNet | None:
    """A network learned from labelled rows outside the held-out fold; None if there are none."""
    usable = F.col(lang).isNotNull() & ~_in_fold(ident, folds, fold) & F.col(text).rlike(r"\p{L}")
    place = F.pmod(F.xxhash64(F.col(ident), F.lit(1)), F.greatest(F.lit(1), F.length(text) - WINDOW + 1)) + 1
    h = F.xxhash64(F.col(ident))
    counts = {r["lang"]: r["n"] for r in docs.filter(usable).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return None
    each = max(LEAST_EACH, SAMPLE // len(counts))
    # A threshold at twice a language's share goes first, so no task hands on more windows than that.
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, 2.0 * each / n) * (1 << 31)))])
    near = docs.filter(usable & (F.pmod(h, F.lit(1 << 31)) <= F.element_at(share, F.col(lang)))).select(
        h.alias("h"), F.col(lang).alias("lang"), F.substring(F.col(text), place.cast("int"), F.lit(WINDOW)).alias("t"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "t"))
    sample = near.withColumn("rn", first).filter(F.col("rn") <= each).select("h", "lang", "t").collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], r["t"]))
    if not sample:
        return None
    classes = sorted({r["lang"] for r in sample})
    net = ByteConvNet(classes)
    if len(classes) > 1:
        index = {c: i for i, c in enumerate(classes)}
        net.train(_windows([r["t"].encode() for r in sample]), np.array([index[r["lang"]] for r in sample]))
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to all rows and columns of ``docs``."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.struct("*").alias("row"), letter.alias("letter"))
    schema = T.StructType([base.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                letters = batch.column("letter").to_numpy(zero_copy_only=False)
                names = np.full(batch.num_rows, UNKNOWN, dtype=object)
                scores = np.zeros(batch.num_rows)
                if scorer and letters.any():
                    p = scorer.predict(*raw(batch.column("row").field(text)))
                    names[letters] = np.array(net.classes, dtype=object)[p.argmax(axis=1)][letters]
                    scores[letters] = p.max(axis=1)[letters]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def identify(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: identifier, ``held_out``, ``lang_pred``, ``score``."""
    net = train(docs, ident, text, lang)
    slim = docs.select(F.col(ident).alias("id"), F.coalesce(_in_fold(ident, 5, 0), F.lit(False)).alias("held_out"), F.col(text).alias("t0"))
    done = predict(slim, net, "t0")
    return done.select(F.col("row.id").alias(ident), "row.held_out", "lang_pred", "score")
