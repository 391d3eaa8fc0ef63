"""Links between documents whose word-shingle sets overlap, by an R-tree over count vectors.

A document's set is hashed into ``GROUPS`` groups; the number of its elements in each is a point. Two
sets share at most the sum of the smaller coordinates of their points, and a node of the tree, which
holds the greatest coordinates and the least size of its points, bounds what any of them can share
with a point in the same way. Nodes and points whose bound is below what the similarity asks for are
cut off; what survives is verified on the whole sets.

Such a tree alone would compare every point with nearly every node, as documents that have nothing in
common still have similar counts. So the directory routes: two sets similar enough share an element
among the first few of each in a common order (those left after taking away the share both must
have), and a point is only led to nodes with which it shares such an element. The order puts
elements found in many documents last, so passages that many documents share do not lead anywhere.

The tree is packed bottom-up. Points are compared with one leading point of each of their elements;
verified links join points into nodes. Later rounds are led by the points that have linked with most
leaders before, as the middle of a group of near copies is similar to nearly all of it while any other
two may not be. After ``PACKINGS`` rounds, with other leaders in each, every
point that shares enough of those elements with another node descends: the bounds of its pages (at
most ``PAGE`` points of near sizes), then the points', then the sets. Points of one node are
linked already and never compared again, so large groups of near copies cost no pair table.

Points have few coordinates, so they say little of large sets. Pairs that pass them are compared by
points with about one coordinate for each element before any whole set is shuffled.

Links are counted in the components. Rows with equal sets are one class; of every component with more
than two classes all pairs of class representatives are compared, page against page, as products of
their element matrices in a task, so no table holds a row per pair. A class counts with its size.

Defined results: texts without words, and null texts, have an empty set and link with nothing. With
fewer words than a shingle has, the whole sequence is the only shingle. Rows with a null identifier
take part; a component's name is its least identifier that is not null. Sets are compared by the
lower 48 bits of 64-bit hashes. Texts of any length are read whole. An empty table gives an empty result. Extra
columns are carried by ``keep_one_per_group``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytewords import distinct, mix, words
from tidemark.llm.common import giving_back
from tidemark.llm.graph import components
from tidemark.session import staged as staged_plain

GROUPS = 64
PACKINGS = 3
PAGE = 128
SMALL = 32
ELEMENTS = 500_000  # elements of a page of representatives, on average
MOST_SENT = 500_000  # row numbers that may be broadcast (about 16 MB as a hash table)
LEAST_COMMON, MOST_COMMON = 64, 1_000_000  # occurrences that make an element common; bound of the table of common ones
_SLICE = 500
_BATCH = 250  # rows of an Arrow batch, which hold whole texts, sets or two sets each
_TOGETHER = 4_000_000  # elements counted together
_SHARES = 8  # parts of the hash range in which they are, one after the other
_COLUMNS = 16_384
_LOW = (1 << 48) - 1
_FULL = 65535  # a coordinate this large stands for any greater one
_FINE_FULL = 15  # the same of a fine point
_STEP = 0x9E3779B97F4A7C15


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """A staged table, written with small Arrow batches: batches of texts or sets take several times their size off the heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(min(_BATCH, int(before)) if int(before) > 0 else _BATCH))
    try:
        return staged_plain(df, purpose)
    finally:
        conf.set(name, before)


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and the first of each text."""
    w = words(column)
    h, n = w.hashes(), w.counts()
    whole = np.zeros(len(h), np.uint64)
    for j in range(width):
        m = max(0, len(h) - j)  # all texts together may hold fewer words than a shingle
        whole[:m] = whole[:m] * np.uint64(_STEP) + h[j : j + m]
    whole = mix(whole ^ np.uint64(width))
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], counts)
    out = whole[at]
    for i in np.flatnonzero((n > 0) & (n < width)):  # short texts: the sequence itself, apart from longer ones
        value = n[i]
        for x in h[w.first[i] : w.first[i + 1]].tolist():
            value = (int(value) * _STEP + x) & 0xFFFFFFFFFFFFFFFF
        out[first[i]] = mix(np.array([value], np.uint64))[0]
    return out, first


def _repeated(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n, all): elements that occur more than once in the parts together, and the number of all."""
    names = ["token", "n", "all"]
    for share in range(_SHARES):  # there are millions, so they are not put together all at once
        flat = np.concatenate([part[part % np.uint64(_SHARES) == share] for part in parts]) if parts else np.zeros(0, np.uint64)
        flat.sort()
        equal = np.flatnonzero(flat[1:] == flat[:-1])
        heads = np.flatnonzero(np.diff(equal, prepend=-2) != 1)
        again, n = flat[equal[heads]], np.diff(np.append(heads, len(equal))) + 1
        yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([sum(map(len, parts))])], names=names)


def common_elements(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that occur in many documents, sorted, with the logarithm of how often.

    Every run of documents of ``_TOGETHER`` elements reports those it holds more than once. An element counts as common
    from ``LEAST_COMMON`` such occurrences on, or from as many as keep the table under
    ``MOST_COMMON`` entries. The order only steers the search; any table gives the same links.
    """

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            parts += [_shingles(batch.slice(at, _SLICE).column("text"), width)[0] & np.uint64(_LOW) for at in range(0, batch.num_rows, _SLICE)]
            if sum(map(len, parts)) >= _TOGETHER:
                yield from _repeated(parts)
                parts = []
        yield from _repeated(parts)

    seen = staged(docs.select("text").mapInArrow(count, "token long, n long, all long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).filter(
        (F.col("n") >= LEAST_COMMON) | (F.col("all") > 0)), "common")
    total = seen.agg(F.sum("all").alias("t")).first()["t"] or 0
    least = max(LEAST_COMMON, -(-total // MOST_COMMON))  # at most total / least elements can occur so often
    rows = seen.filter((F.col("n") >= least) & (F.col("token") >= 0)).select("token", F.log2("n").cast("int").alias("level")).toArrow()
    tokens, levels = rows.column("token").to_numpy().astype(np.uint64), rows.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def set_table(docs: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (row, id, n, digest, point, tokens): the set in the common order as 6-byte numbers, its counts by group, a sum of its hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    kind = dict(docs.dtypes)["id"]

    @giving_back
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                h, first = _shingles(batch.column("text"), width)
                sizes, digests, points, sets = [], [], [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = distinct(h[a:b])[0]
                    sizes.append(len(own))
                    digests.append(int(mix(own).sum(dtype=np.uint64).astype(np.int64)))
                    low = own & np.uint64(_LOW)
                    low.sort()
                    if len(keys) and len(low):
                        place = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
                        level = np.where(keys[place] == low, levels[place], 0)
                        if level.any():
                            low = low[np.argsort(level, kind="stable")]
                    points.append(np.minimum(np.bincount((low % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS), _FULL).astype(np.uint16).tobytes())
                    sets.append(low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(points, pa.binary()), pa.array(sets, pa.binary())],
                    names=["id", "n", "digest", "point", "tokens"])

    made = docs.select("id", "text").mapInArrow(build, f"id {kind}, n long, digest long, point binary, tokens binary")
    return staged(made.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def _numbers(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def leading_elements(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (token, row, n): of every set the elements of which a similar set must share one."""

    @giving_back
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                sizes = batch.column("n").to_numpy()
                take = np.where(sizes > 0, sizes - (sizes * percent + 99) // 100 + 1, 0)
                own = [_numbers(t.as_buffer()[: 6 * k]) for t, k in zip(batch.column("tokens"), take.tolist(), strict=True)]
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                each = [len(t) for t in own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(flat.view(np.int64)), pa.array(np.repeat(batch.column("row").to_numpy(), each)), pa.array(np.repeat(sizes, each)),
                ], names=["token", "row", "n"])

    return sets.select("row", "n", "tokens").mapInArrow(lead, "token long, row long, n long")


def _asked(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of two sets of these sizes: percent / (100 + percent) of their sum, rounded up."""
    return -(-(percent * (na + nb)) // (100 + percent))


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Keeps pairs (a, na, pa, b, nb, pb) whose summed minima reach what is asked."""

    @giving_back
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, GROUPS) for c in ("pa", "pb"))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            least = np.minimum(x, y)
            good = (least.sum(axis=1, dtype=np.int64) >= _asked(na, nb, percent)) | (least == _FULL).any(axis=1)
            yield batch.select(["a", "b", "same"]).filter(pa.array(good))

    same = "same" if "same" in pairs.columns else F.lit(False).alias("same")
    return pairs.select("a", "na", "pa", "b", "nb", "pb", same).mapInArrow(keep, "a long, b long, same boolean")


def _fine_point(own: np.ndarray) -> bytes:
    """Counts of a set by as many groups as it has elements, rounded up to a power of two; half a byte each."""
    groups = 1 << max(GROUPS, len(own) - 1).bit_length()
    counts = np.minimum(np.bincount((own % np.uint64(groups)).astype(np.int64), minlength=groups), _FINE_FULL).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _fine_bound(x: bytes, y: bytes) -> int | None:
    """What two sets share at most by their fine points, of which the longer is folded; None if a coordinate is full."""
    sides = []
    for packed in (x, y):
        halves = np.frombuffer(packed, np.uint8)
        counts = np.empty(2 * len(halves), np.int64)
        counts[::2], counts[1::2] = halves & 15, halves >> 4
        if counts.max() == _FINE_FULL:
            return None
        sides.append(counts)
    groups = min(map(len, sides))
    return int(np.minimum(*(counts.reshape(-1, groups).sum(axis=0) for counts in sides)).sum())


def _asked_for(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that some pair (a, b) asks for, as long as their numbers are few enough to be sent to every task."""
    asked = staged(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "jaccard-asked")
    return sets.join(F.broadcast(asked) if asked.count() <= MOST_SENT else asked, "row", "left_semi")


def _finely_bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Keeps pairs (a, b) whose fine points allow a link; these are a twelfth of the sets in size."""

    @giving_back
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [_fine_point(_numbers(t.as_buffer())) for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(fine, pa.binary())], names=["row", "n", "fine"])

    @giving_back
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = _asked(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent).tolist()
            most = [_fine_bound(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array([m is None or m >= k for m, k in zip(most, asked, strict=True)], pa.bool_()))

    fine = staged(_asked_for(pairs, sets.select("row", "n", "tokens")).mapInArrow(reduce, "row long, n long, fine binary"), "jaccard-fine")
    side = lambda x: fine.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "na", "fa", "b", "nb", "fb")
    return staged(met.mapInArrow(keep, "a long, b long"), "jaccard-near")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among candidate pairs (a, b): those whose whole sets are similar enough."""
    pairs = _finely_bounded(pairs, sets, percent)
    sets = _asked_for(pairs, sets)

    def side(x: str) -> DataFrame:
        return sets.select(F.col("row").alias(x), F.col("tokens").alias(f"t{x}"))

    @giving_back
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = _numbers(x.as_buffer()), _numbers(y.as_buffer())
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(check, "u long, v long")


def _sized(least: str, most: str, other: str, percent: int) -> str:
    """Condition that sizes from least to most hold one that can be similar to a set of size other."""
    return f"{most} * 100 >= {other} * {percent} AND {other} * 100 >= {least} * {percent}"


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, na, b, nb) of similar sizes: summed minima, then the sets, unless these are equal by size, digest and point."""
    side = lambda x: sets.select(F.col("row").alias(x), F.col("point").alias(f"p{x}"), F.col("digest").alias(f"d{x}"))
    same = ((F.col("na") == F.col("nb")) & (F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))).alias("same")
    near = staged(_bounded(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "na", "pa", "b", "nb", "pb", same), percent), "jaccard-pairs")
    equal = near.filter("same").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return staged(equal.unionByName(_verified(near.filter("NOT same"), sets, percent)), "jaccard-links")


def _open(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (token, row, n, k, comp) of elements that still lead to more than one node."""
    names = comps.withColumnRenamed("node", "row")
    if comps.count() <= MOST_SENT:
        names = F.broadcast(names)
    named = blocks.join(names, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    apart = named.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("token")
    return named.join(apart, "token")


def _extended(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the links between components found so far are solved, by the components' names."""
    names = comps.select("node", "comp")
    if comps.count() <= MOST_SENT:
        names = F.broadcast(names)
    for end in ("u", "v"):
        links = links.join(names.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    joined = staged(components(links), "jaccard-joined")
    renamed = joined.select(F.col("node").alias("comp"), F.col("comp").alias("least"))
    if renamed.count() <= MOST_SENT:
        renamed = F.broadcast(renamed)
    old = comps.join(renamed, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
    return staged(old.unionByName(joined.join(comps.select("node"), "node", "left_anti").select("node", "comp")), "jaccard-comps")


def _hits(links: DataFrame, leads: DataFrame) -> DataFrame:
    """Rows (row, hits): with how many of these leading rows a row has linked, be it a leading row itself or not."""
    ends = links.select("u", F.col("v").alias("row")).unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("row")))
    return staged(ends.join(leads.distinct().withColumnRenamed("row", "u"), "u", "left_semi").groupBy("row").agg(F.count("*").alias("hits")), "rtree-hits")


def _by_row(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    return blocks.join(F.broadcast(hits) if hits.count() <= MOST_SENT else hits, "row", "left")


def _led(blocks: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Pairs of the rows of every block with its leading row, where sizes allow a link."""
    pairs = blocks.join(leads, "token").filter("row <> lead.row").filter(_sized("n", "n", "lead.n", percent))
    flip = F.col("row") < F.col("lead.row")
    return pairs.select(
        F.least("row", "lead.row").alias("a"), F.when(flip, F.col("n")).otherwise(F.col("lead.n")).alias("na"),
        F.greatest("row", "lead.row").alias("b"), F.when(flip, F.col("lead.n")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def _descend(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between rows of different nodes, found from the nodes' bounds down."""
    rows = opened.select("row", "n", "comp").distinct()
    place = F.row_number().over(Window.partitionBy("comp", "salt").orderBy("n", "row"))
    # Pages hold neighbours in size; a salt of the row spreads large nodes over tasks.
    paged = staged(rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64))).withColumn("page", F.xxhash64("comp", "salt", F.floor((place - 1) / PAGE))), "rtree-pages")
    spans = paged.groupBy("page").agg(F.first("comp").alias("other"), F.min("row").alias("only"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k"))
    # Which pages of other nodes a row meets in any of its elements, sizes allowing. Two rows meet one way only: through
    # the page of one point, if one of them has such a page, else through the page of the greater node.
    places = opened.join(paged.select("row", "page").join(spans.select("page", F.col("k").alias("own")), "page"), "row")
    by_page = places.select("token", "page").distinct().join(spans, "page")
    met = places.select("token", F.col("row").alias("a"), F.col("n").alias("na"), "comp", "own").join(by_page, "token").filter("comp <> other").filter(
        "CASE WHEN k = 1 THEN own > 1 OR a < only ELSE own > 1 AND comp < other END").filter(_sized("least", "most", "na", percent)).groupBy("a", "na", "page", "least", "most", "k").agg(F.count("*").alias("shared"))
    # Of two sets, one has all it can share up to the end of its leading elements among those it does share there.
    short = lambda nb: f"ceil({percent} * (na + {nb}) / {100 + percent}) - ceil({percent} * greatest(na, {nb}) / 100) + 1"
    met = staged(met.filter(f"shared >= least({short('least')}, {short('most')})").select("a", "na", F.col("page").alias("b"), F.col("least").alias("nb"), "k"), "rtree-met")
    points = sets.select(F.col("row").alias("a"), F.col("point").alias("pa"))
    # A page of one point is met through the point itself.
    single = paged.join(spans.filter("k = 1").select("page"), "page").select(F.col("row").alias("to"), F.col("n").alias("nb"), F.col("page").alias("b"))
    alone = met.filter("k = 1").select("a", "na", "b").join(single, "b").select("a", "na", F.col("to").alias("b"), "nb")

    def box(group: pa.Table) -> pa.Table:
        top = np.frombuffer(b"".join(group.column("pa").to_pylist()), np.uint16).reshape(-1, GROUPS).max(axis=0)
        return pa.table({"b": group.column("b").slice(0, 1), "pb": pa.array([top.tobytes()], pa.binary())})

    full = paged.join(spans.filter("k > 1").select("page"), "page")
    boxes = full.join(points.withColumnRenamed("a", "row"), "row").select(F.col("page").alias("b"), "pa").groupBy("b").applyInArrow(box, "b long, pb binary")
    down = _bounded(met.filter("k > 1").join(points, "a").join(boxes, "b"), percent)
    inside = full.select(F.col("page").alias("b"), F.col("row").alias("to"), F.col("n").alias("nb"))
    opened_pages = down.join(met.select("a", "na").distinct(), "a").join(inside, "b").filter(_sized("nb", "nb", "na", percent)).select("a", "na", F.col("to").alias("b"), "nb")
    pairs = alone.unionByName(opened_pages)
    flip = F.col("a") < F.col("b")
    ordered = pairs.select(F.least("a", "b").alias("a"), F.when(flip, F.col("na")).otherwise(F.col("nb")).alias("na"),
                           F.greatest("a", "b").alias("b"), F.when(flip, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    return _links(ordered.distinct(), sets, percent)


def similar_groups(
    df: DataFrame, percent: int = 80, width: int = 5, ident: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: identifier, ``n_shingles``, ``component_id``, the least identifier reachable over links, and ``n_links``, the rows it links with."""
    docs = df.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    sets = set_table(docs, width, common_elements(docs, width))
    named = staged(group_rows(sets.withColumn("mark", F.xxhash64("point")), percent, "digest", "mark"), "jaccard-named")
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    linked = staged(link_counts(named, sets, percent), "jaccard-counts")
    if linked.count() <= MOST_SENT:
        linked = F.broadcast(linked)
    return named.join(linked, ["comp", "n", "digest", "mark"], "left").join(least, "comp").select(
        F.col("id").alias(ident), F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def link_counts(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (comp, n, digest, mark, n_links) of the classes of equal sets whose rows link with any other row."""
    classes = staged(named.filter("n > 0").groupBy("comp", "n", "digest", "mark").agg(F.min("row").alias("row"), F.count("*").alias("k")), "jaccard-classes")
    spans = classes.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.sum("k").alias("rows")).filter("rows > 1")
    pages = F.least("m", F.ceil(F.greatest(F.col("all") / ELEMENTS, F.col("m") / PAGE))).cast("int")
    spanned = staged(classes.join(spans, "comp").withColumn("pages", pages), "jaccard-spans")
    # Two classes of a component are linked, as nothing else joins them.
    reps = spanned.filter("m > 2").select("row", "k", "comp", "pages", F.pmod(F.xxhash64("row", F.lit(PAGE)), "pages").cast("int").alias("page"))
    if reps.count() <= MOST_SENT:
        reps = F.broadcast(reps)
    meets = sets.select("row", "tokens").join(reps, "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    meets = meets.select("comp", F.least("page", "other").alias("lo"), F.greatest("page", "other").alias("hi"), "page", "row", "k", "tokens")

    def count(group: pa.Table) -> pa.Table:
        rows, k, page = (group.column(c).to_numpy() for c in ("row", "k", "page"))
        own = [_numbers(t.as_buffer()) for t in group.column("tokens")]
        n = np.array([len(t) for t in own], np.int64)
        good = _similar(own, n, percent)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        if lo < hi:
            good &= page[:, None] != page[None, :]
        np.fill_diagonal(good, False)
        links = good @ k
        some = links > 0
        return pa.table({"row": rows[some], "links": links[some]})

    met = meets.groupBy("comp", "lo", "hi").applyInArrow(count, "row long, links long").groupBy("row").agg(F.sum("links").alias("links"))
    others = F.when(F.col("m") == 2, F.col("rows") - F.col("k")).otherwise(F.coalesce("links", F.lit(0)))
    return spanned.join(met, "row", "left").select("comp", "n", "digest", "mark", (F.col("k") - 1 + others).alias("n_links")).filter("n_links > 0")


def _similar(own: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Which of these sets are similar enough to which: intersections are products of the matrix of sets by elements."""
    owner = np.repeat(np.arange(len(own)), n)
    _, place, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    kept = times > 1  # others are in no intersection
    number = np.cumsum(kept) - 1
    inside = kept[place]
    owner, place = owner[inside], number[place[inside]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(own), len(own)), np.int64)
    for at in range(0, int(kept.sum()), _COLUMNS):
        a, b = np.searchsorted(place, (at, at + _COLUMNS))
        held = np.zeros((len(own), min(_COLUMNS, int(kept.sum()) - at)), np.float32)
        held[owner[a:b], place[a:b] - at] = 1
        common += (held @ held.T).astype(np.int64)  # exact: below 2 to the power 24
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def keep_one_per_group(
    df: DataFrame, percent: int = 80, width: int = 5, ident: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The row with the least identifier of every group (of equal ones the first row), with all its columns.

    Only rows that lose are looked up again, by a number that the written input carries.
    """
    own = staged(df.select(F.struct("*").alias("all"), F.monotonically_increasing_id().alias("at")), "jaccard-input")
    docs = own.select(F.struct(F.col(f"all.{ident}").alias("id"), "at").alias("id"), F.col(f"all.{text}").alias("text"))
    named = group_rows(set_table(docs, width, common_elements(docs, width)), percent)
    rank = F.struct(F.col("id.id").isNull(), F.col("id.id"), F.col("id.at"))
    best = named.groupBy("comp").agg(F.min(rank).alias("best"), F.count("*").alias("k")).filter("k > 1")
    lost = staged(named.join(best, "comp").filter(F.col("id.at") != F.col("best.at")).select(F.col("id.at").alias("at")), "jaccard-lost")
    if lost.count() <= MOST_SENT:
        lost = F.broadcast(lost)
    return own.join(lost, "at", "left_anti").select("all.*")


def group_rows(sets: DataFrame, percent: int, *also: str) -> DataFrame:
    """Rows (row, id, n, comp) of a set table and other columns asked for; comp is the least row reachable over links."""
    postings = leading_elements(sets, percent).repartition("token")  # shuffled once, read for the counts and for the rows
    shared = postings.groupBy("token").agg(F.count("*").alias("k"), F.min(F.struct("row", "n")).alias("lead")).filter("k > 1")
    blocks = staged(postings.join(shared, "token").select("token", "row", "n", "k", F.col("lead.row").alias("lead"), F.col("lead.n").alias("na")), "rtree-blocks")
    first = blocks.filter("row <> lead").filter(_sized("na", "na", "n", percent)).select(
        F.col("lead").alias("a"), "na", F.col("row").alias("b"), F.col("n").alias("nb")).distinct()
    found = _links(first, sets, percent)
    comps = staged(components(found), "jaccard-comps")
    # Every row has met the leading row of its elements, so these and elements of two rows are done with.
    rest = blocks.filter("k > 2 AND row <> lead").drop("lead", "na")
    opened = staged(_open(rest, comps), "rtree-open")
    # Elements of many rows are led again by others; small ones cost no more in the descent.
    large = opened.filter(f"k > {SMALL}")
    led, hits = False, _hits(found, first.select(F.col("a").alias("row")))
    for turn in range(1, PACKINGS):
        if large.isEmpty():
            break
        led = True
        central = F.struct(F.coalesce("hits", F.lit(0)), F.xxhash64("row", F.lit(turn)), "row", "n", "comp")
        leads = staged(_by_row(large, hits).groupBy("token").agg(F.max(central).alias("lead")), "rtree-leads")
        more = _links(_led(large.join(leads.select("token", F.col("lead.comp").alias("c")), "token").filter("comp <> c").drop("c"), leads, percent), sets, percent)
        comps = _extended(comps, more)
        hits = hits.unionByName(_hits(more, leads.select("lead.row"))).groupBy("row").agg(F.sum("hits").alias("hits"))
        large = staged(_open(large.drop("comp"), comps), "rtree-open")
    if led:
        opened = staged(_open(opened.drop("comp"), comps), "rtree-open")
    if not opened.isEmpty():
        comps = _extended(comps, _descend(opened, sets, percent))
    slim = sets.select("row", "id", "n", *also)
    return slim.join(comps.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
