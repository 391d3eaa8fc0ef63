"""Hard negatives of anchor vectors, found exactly with a multiway hyperplane tree (GNAT style).

Every inner node of the tree holds up to ``FAN`` split points, and a vector belongs to the child whose
split point is nearest. The node keeps, for each split point and each child, the least and greatest
distance from the split point to the vectors below that child. A query asks for scores in a window; as
score and distance are tied by the norms, that is an annulus around the query. A child goes as soon as,
for one of the split points, its range does not meet the ring the annulus allows there. What is left are
leaves, whose vectors are all scored with exact integer products.

The split points are chosen on the driver from a sample of at most ``SAMPLE`` vectors (fewer if they are
very wide) by a hash of the row; the bound is a parameter of the index, not of the search: every row is
led down the tree, ranges and norms are taken over all rows, and every leaf is kept in blocks of bounded
size, however many rows are alike. The sample serves once more: its rows are rows of the table, so the
k-th best of them is a bound that narrows a query's annulus before the search begins.

Anchors travel in groups to the blocks of the leaves that are left for any of them, by an equi-join on
the block; a block hands on at most k rows of each anchor and window, which are merged. The first search
finds the positives (same label, no upper limit), the second the negatives of their windows.

Defined results: rows with a null label, a null vector, or a component that is null or not finite take no
part. Vectors of differing lengths meet on the components they share; an empty one scores 0 everywhere. A
null identifier is no anchor, and comes last among equal scores; repeated identifiers are rows of their
own, each an anchor, and any of them may be the other's positive. Anchors without positives, and positives
without negatives in the window, give no rows; a positive with a negative score has an empty window. Tables
without rows or anchors give none. Labels are integers. Components are floor(scale * x); scores, and norms
times four, must fit 53 bits to be computed fast, and 64 bits to be right. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import hash_sample, tasks
from tidemark.llm.topk_search import select
from tidemark.session import staged

FAN = 8
SAMPLE = 4096
LEAF = 64  # rows of the sample in a leaf, at most
BLOCK = 4096  # rows of a block, at most on average
QUERIES = 256  # anchors of a group, at most on average
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # score limits that are none
COMPONENTS = 1 << 22  # numbers in a block, or in the sample times four


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, over the components they share."""
    shared = min(a.shape[1], b.shape[1])
    a, b = a[:, :shared], b[:, :shared]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, shared)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def norms(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.float64), a.astype(np.float64))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms(a)[:, None] + norms(b)[None, :] - 2.0 * products(a, b), 0.0))


def padded(vectors: list, width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


@dataclass
class Tree:
    """Split points of the inner nodes, their children (inner nodes from 0, leaves as -1 - leaf), and the way to every leaf."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)

    @staticmethod
    def fit(sample: np.ndarray, seed: int = 5) -> Tree:
        tree, rng = Tree(), np.random.default_rng(seed)

        def grow(rows: np.ndarray, path: list[tuple[int, int]]) -> int:
            chosen = tree._spread(sample, rows, rng) if len(rows) > LEAF else []
            if len(chosen) < 2:
                tree.paths.append(path)
                return -len(tree.paths)
            node = len(tree.points)
            tree.points.append(sample[chosen])
            tree.children.append([])
            near = distances(sample[rows], tree.points[node]).argmin(axis=1)
            for j in range(len(chosen)):
                tree.children[node].append(grow(rows[near == j], [*path, (node, j)]))
            return node

        grow(np.arange(len(sample)), [])
        return tree

    @staticmethod
    def _spread(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[int]:
        """Rows far from each other, out of three times as many drawn ones."""
        drawn = rng.choice(rows, size=min(len(rows), 3 * FAN), replace=False)
        away = distances(sample[drawn], sample[drawn])
        chosen = [0]
        least = away[0].copy()
        while len(chosen) < FAN and least.max() > 1e-6:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, away[chosen[-1]])
        return [int(drawn[i]) for i in chosen]

    def leaf_of(self, m: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        out = np.zeros(len(m), dtype=np.int32)
        open_ = [(0, np.arange(len(m)))] if self.points else []
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            near = distances(m[rows], self.points[node]).argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                if child < 0:
                    out[rows[near == j]] = -1 - child
                else:
                    open_.append((child, rows[near == j]))
        return out

    def spans(self, leaf: int, m: np.ndarray) -> tuple[list[float], list[float]]:
        """Least and greatest distances from the split points on a leaf's way to some of its vectors, node after node."""
        low, high = [], []
        for node, _ in self.paths[leaf]:
            d = distances(m, self.points[node])
            low += d.min(axis=0).tolist()
            high += d.max(axis=0).tolist()
        return low, high


@dataclass
class Ask:
    """What a group of anchors asks of a search: scores between ``low`` and ``high``, of rows with their label or with others."""

    m: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def __post_init__(self) -> None:
        self.norm = norms(self.m)
        self.low = np.where(self.low == _LEAST, -np.inf, self.low.astype(np.float64))
        self.high = np.where(self.high == _MOST, np.inf, self.high.astype(np.float64))

    def of(self, rows: np.ndarray) -> Ask:
        return Ask(self.m[rows], self.labels[rows], self.low[rows], self.high[rows], self.same)

    def meets(self, to_points: np.ndarray, low: np.ndarray, high: np.ndarray, head: dict) -> np.ndarray:
        """Which anchors' annuli meet the ranges that a subtree has from the split points of a node."""
        # Distance and score of a vector c: d * d = |q|^2 + |c|^2 - 2 score.
        outer = np.sqrt(np.maximum(self.norm + head["most_norm"] - 2 * self.low, 0.0))
        inner = np.sqrt(np.maximum(self.norm + head["least_norm"] - 2 * self.high, 0.0))
        # Distances are roots of sums with rounding errors, which count most near 0.
        slack = 1e-5 * (np.sqrt(self.norm) + np.sqrt(head["most_norm"]) + to_points.max(axis=1, initial=0.0) + 1)
        apart = (low[None, :] - to_points > (outer + slack)[:, None]) | (to_points - high[None, :] > (outer + slack)[:, None])
        apart |= to_points + high[None, :] < (inner - slack)[:, None]
        return ~apart.any(axis=1) & self.possible(head)

    def possible(self, head: dict) -> np.ndarray:
        """Which anchors can find a score and a label they ask for below a head at all."""
        good = self.norm + head["most_norm"] - 2 * self.low > -1e-6 * (self.norm + head["most_norm"] + 1)
        if self.same:
            return good & (self.labels >= head["least_label"]) & (self.labels <= head["most_label"])
        return good & ((self.labels != head["least_label"]) | (self.labels != head["most_label"]))


@dataclass
class Index:
    """The tree with what all rows say about its nodes: ranges by split point and child, norms, labels."""

    tree: Tree
    heads: dict[int, dict]  # by child number as in ``children``; leaves hold the ranges of all split points on their way
    blocks: dict[int, int]  # blocks of a leaf
    ranges: list[tuple[np.ndarray, np.ndarray]]  # of an inner node, by split point and child
    sample: np.ndarray
    sample_rows: np.ndarray
    sample_labels: np.ndarray

    def block_counts(self) -> list[int]:
        return [self.blocks.get(leaf, 1) for leaf in range(len(self.tree.paths))]

    def leaves(self, ask: Ask) -> np.ndarray:
        """Which anchors have to look into which leaf."""
        out = np.zeros((len(ask.m), len(self.tree.paths)), dtype=bool)
        if not self.tree.points:
            out[:, 0] = 0 in self.blocks
            return out
        open_ = [(0, np.arange(len(ask.m)))]
        while open_:
            node, rows = open_.pop()
            part = ask.of(rows)
            to_points = distances(part.m, self.tree.points[node])
            low, high = self.ranges[node]
            for j, child in enumerate(self.tree.children[node]):
                if child not in self.heads:  # no row below it
                    continue
                left = rows[part.meets(to_points, low[:, j], high[:, j], self.heads[child])]
                if not len(left):
                    continue
                if child < 0:
                    out[left, -1 - child] = True
                else:
                    open_.append((child, left))
        return out


def vectors_of(df: DataFrame, ident: str, vector: str, label: Column, scale: int) -> DataFrame:
    """Rows (id, row, label, v) of everything that takes part."""
    x = F.col(vector)
    usable = label.isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(usable).select(
        F.col(ident).alias("id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _lists(column: pa.Array) -> np.ndarray:
    """A batch's vectors as one matrix."""
    return padded(column.to_pylist(), int(pa.compute.max(pa.compute.list_value_length(column)).as_py() or 0))


def build(rows: DataFrame, width: int) -> tuple[Index, DataFrame, DataFrame]:
    """The index of staged rows, the rows with their leaf, and the blocks of the leaves."""
    spark = rows.sparkSession
    taken = hash_sample(rows, "row", max(1, min(SAMPLE, 4 * COMPONENTS // max(1, width)))).collect()
    sample = padded([r["v"] for r in taken], max((len(r["v"]) for r in taken), default=0))
    tree = Tree.fit(sample)
    shared = spark.sparkContext.broadcast(tree)  # as many split points as the sample has rows, at most

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf_of(_lists(batch.column("v"))))], names=[*batch.schema.names, "leaf"])

    kind = dict(rows.dtypes)["id"]
    led = staged(rows.mapInArrow(lead, f"id {kind}, row long, label long, v array<long>, leaf int"), "gnat-rows")
    size = max(1, min(BLOCK, COMPONENTS // max(1, width)))
    blocks = {r["leaf"]: -(-r["n"] // size) for r in led.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        m, labels = _lists(group.column("v")), group.column("label").to_numpy()
        low, high = shared.value.spans(key[0].as_py(), m)
        n = norms(m)
        return pa.Table.from_pylist([{
            "leaf": key[0].as_py(), "part": key[1].as_py(), "width": m.shape[1], "ids": group.column("id").to_pylist(), "rows": group.column("row").to_pylist(),
            "labels": labels.tolist(), "m": m.tobytes(), "low": low, "high": high, "least_norm": float(n.min()), "most_norm": float(n.max()),
            "least_label": int(labels.min()), "most_label": int(labels.max()),
        }], shape)

    schema = (f"leaf int, part int, width int, ids array<{kind}>, rows array<long>, labels array<long>, m binary, low array<double>, high array<double>, "
              "least_norm double, most_norm double, least_label long, most_label long")
    shape = to_arrow_schema(T.StructType.fromDDL(schema))
    part = F.pmod(F.xxhash64("row"), _by_leaf([blocks.get(i, 1) for i in range(len(tree.paths))])).cast("int")
    packed = staged(led.withColumn("part", part).repartition(_parts(rows, blocks), "leaf", "part").groupBy("leaf", "part").applyInArrow(pack, schema), "gnat-blocks")
    least = packed.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("slot", "d")).groupBy("leaf", "slot").agg(F.min("d.low").alias("low"), F.max("d.high").alias("high"))
    heads = packed.groupBy("leaf").agg(*[f(c).alias(c) for f, c in ((F.min, "least_norm"), (F.max, "most_norm"), (F.min, "least_label"), (F.max, "most_label"))])
    slots = {(r["leaf"], r["slot"]): (r["low"], r["high"]) for r in least.collect()}  # bounded by the tree
    index = Index(tree, {-1 - r["leaf"]: r.asDict() for r in heads.collect()}, blocks, [], sample,
                  np.array([r["row"] for r in taken], np.int64), np.array([r["label"] for r in taken], np.int64))
    _climb(index, slots)
    return index, led, packed


def _climb(index: Index, slots: dict) -> None:
    """Ranges and heads of the inner nodes from those of the leaves below them."""
    tree = index.tree
    index.ranges.extend((np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree.points)
    for leaf, path in enumerate(tree.paths):
        own = index.heads.get(-1 - leaf)
        if own is None:
            continue
        slot = 0
        for node, child in path:
            low, high = index.ranges[node]
            for i in range(len(tree.points[node])):
                a, b = slots[leaf, slot]
                low[i, child], high[i, child] = min(low[i, child], a), max(high[i, child], b)
                slot += 1
            up = tree.children[node][child]
            if up >= 0:
                head = index.heads.setdefault(up, dict(own))
                for name in ("least_norm", "least_label"):
                    head[name] = min(head[name], own[name])
                for name in ("most_norm", "most_label"):
                    head[name] = max(head[name], own[name])


def _by_leaf(numbers: list[int]) -> Column:
    """A number for each leaf, as a column over ``leaf``."""
    return F.get(F.expr(f"array({', '.join(map(str, numbers))})"), F.col("leaf"))


def _parts(df: DataFrame, blocks: dict[int, int]) -> int:
    """Partitions of work on blocks: small exchanges are not to be joined into a few tasks."""
    return max(tasks(df.sparkSession), sum(blocks.values()) // 8)


def _limits(windows: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper score limits by anchor and window; an anchor with fewer windows has empty ones at the end."""
    most = max(map(len, windows), default=0)
    low, high = np.full((len(windows), most), _MOST), np.full((len(windows), most), _LEAST)
    for i, own in enumerate(windows):
        for j, w in enumerate(own):
            low[i, j] = _LEAST if w["low"] is None else w["low"]
            high[i, j] = _MOST if w["high"] is None else w["high"]
    return low, high


def _scored(ix: Index, r: dict, k: int, same: bool) -> list[dict]:
    """The k best rows of a block for every window of every anchor of a group whose annulus meets the block's ranges."""
    qm = np.frombuffer(r["q_m"], np.int64).reshape(len(r["q_rows"]), r["q_width"])
    labels, rows = np.array(r["q_labels"], np.int64), np.array(r["q_rows"], np.int64)
    low, high = _limits(r["windows"])
    ask = Ask(qm, labels, low.min(axis=1), high.max(axis=1), same)
    left, slot = ask.possible(r), 0
    for node, _ in ix.tree.paths[r["leaf"]]:  # the block's own ranges are narrower than its leaf's
        n = len(ix.tree.points[node])
        left &= ask.meets(distances(qm, ix.tree.points[node]), np.array(r["low"])[slot : slot + n], np.array(r["high"])[slot : slot + n], r)
        slot += n
    some = np.flatnonzero(left)
    if not len(some):
        return []
    cm = np.frombuffer(r["m"], np.int64).reshape(len(r["rows"]), r["width"])
    c_rows, c_labels = np.array(r["rows"], np.int64), np.array(r["labels"], np.int64)
    scores = products(qm[some], cm)
    fit = (labels[some, None] == c_labels) if same else (labels[some, None] != c_labels)
    fit &= (rows[some, None] != c_rows) & (scores >= low[some].min(axis=1)[:, None]) & (scores <= high[some].max(axis=1)[:, None])
    out = []
    for a in np.flatnonzero(fit.any(axis=1)).tolist():  # few anchors find anything in most blocks
        i, near = some[a], np.flatnonzero(fit[a])
        own = scores[a][near]
        for j in range(len(r["windows"][i])):
            inside = np.flatnonzero((own >= low[i, j]) & (own <= high[i, j]))
            if len(inside):
                best = near[inside[select(own[inside], k)]].tolist()
                out += [{"a_row": int(rows[i]), "window": j, "id": r["ids"][b], "row": r["rows"][b], "score": int(scores[a, b])} for b in best]
    return out


def _groups(counts: dict[int, int], tree: Tree) -> tuple[list[int], list[int]]:
    """First group and number of groups of every leaf's anchors: leaves side by side share one while it holds at most ``QUERIES``."""
    first, many, at, room = [], [], 0, QUERIES
    for leaf in range(len(tree.paths)):
        n = counts.get(leaf, 0)
        if n > room:
            at, room = at + 1, QUERIES
        first.append(at)
        many.append(max(1, -(-n // QUERIES)))
        if many[-1] > 1:
            at, room = at + many[-1], QUERIES
        else:
            room -= n
    return first, many


def search(anchors: DataFrame, index: Index, packed: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of every window of every anchor.

    ``anchors`` has id, row, label, v, leaf and ``windows``, an array of (low, high) score limits, null for none.
    Gives rows (a_row, window, id, row, score, rank).
    """
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(index)  # the tree and the sample
    kind = dict(anchors.dtypes)["id"]
    first, many = _groups({r["leaf"]: r["n"] for r in anchors.groupBy("leaf").agg(F.count("*").alias("n")).collect()}, index.tree)
    schema = "leaf int, q_width int, q_rows array<long>, q_labels array<long>, q_m binary, windows array<array<struct<low:bigint,high:bigint>>>"

    def route(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ix = shared.value
        m = padded(pdf["v"].tolist(), max(map(len, pdf["v"])))
        rows, labels, windows = pdf["row"].to_numpy(), pdf["label"].to_numpy(), [list(w) for w in pdf["windows"]]
        low, high = _limits(windows)
        scores = products(m, ix.sample)
        fit = (labels[:, None] == ix.sample_labels) if same else (labels[:, None] != ix.sample_labels)
        fit &= rows[:, None] != ix.sample_rows
        for i in range(len(m)):
            for j in range(len(windows[i])):
                own = scores[i][fit[i] & (scores[i] >= low[i, j]) & (scores[i] <= high[i, j])]
                if len(own) >= k:  # k rows of the table are at least as good
                    low[i, j] = np.partition(own, len(own) - k)[len(own) - k]
                    windows[i][j] = {"low": int(low[i, j]), "high": windows[i][j]["high"]}
        left = ix.leaves(Ask(m, labels, low.min(axis=1), high.max(axis=1), same))
        out = []
        for leaf in np.flatnonzero(left.any(axis=0)).tolist():
            some = np.flatnonzero(left[:, leaf])
            out.append((leaf, m.shape[1], rows[some].tolist(), labels[some].tolist(), m[some].tobytes(), [windows[i] for i in some]))
        return pd.DataFrame(out, columns=["leaf", "q_width", "q_rows", "q_labels", "q_m", "windows"])

    group = _by_leaf(first) + F.pmod(F.xxhash64("row", F.lit(1)), _by_leaf(many)).cast("int")
    slim = anchors.select("row", "label", "v", "leaf", "windows", group.alias("ask"))
    groups = slim.repartition(tasks(spark), "ask").groupBy("ask").applyInPandas(route, schema)
    sent = groups.withColumn("part", F.explode(F.sequence(F.lit(0), _by_leaf(index.block_counts()) - 1)))
    parts = _parts(anchors, index.blocks)
    met = sent.repartition(parts, "leaf", "part").join(packed.repartition(parts, "leaf", "part"), ["leaf", "part"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                found = _scored(ix, batch.slice(at, 1).to_pylist()[0], k, same)
                if found:
                    yield pa.RecordBatch.from_pylist(found, shape)

    result = f"a_row long, window int, id {kind}, row long, score long"
    shape = to_arrow_schema(T.StructType.fromDDL(result))
    found = met.mapInArrow(score, result)
    place = F.row_number().over(Window.partitionBy("a_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Callable[[Column], Column], label: Column, positives: int = 5, negatives: int = 10,
    least_percent: int = 30, most_percent: int = 90, ident: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """Rows ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A negative has another label and a score from ``least_percent`` to ``most_percent`` percent of the positive's.
    """
    rows = staged(vectors_of(df, ident, vector, label, scale), "gnat-vectors")
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    index, led, packed = build(rows, width)
    anchors = led.filter(F.coalesce(is_anchor(F.col("id")), F.lit(False)))
    limit = F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    near = staged(search(anchors.withColumn("windows", F.array(limit)), index, packed, positives, same=True), "gnat-positives")
    # At most ``positives`` rows an anchor.
    lists = near.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("pos"))
    share = lambda p, percent: F.lit(percent).cast("decimal(9,0)") * p["score"].cast("decimal(19,0)") / 100
    window = lambda p: F.struct(F.ceil(share(p, least_percent)).cast("long").alias("low"), F.floor(share(p, most_percent)).cast("long").alias("high"))
    asking = staged(anchors.join(lists, anchors["row"] == lists["a_row"]).drop("a_row"), "gnat-anchors")
    hard = search(asking.withColumn("windows", F.transform("pos", window)), index, packed, negatives, same=False).withColumnRenamed("id", "negative_id")
    own = asking.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id"), "pos")
    p = F.get("pos", F.col("window"))
    return hard.join(own, "a_row").select(
        "anchor_id", p["id"].alias("positive_id"), "rank", "negative_id", p["score"].alias("positive_score"), F.col("score").alias("negative_score"))
