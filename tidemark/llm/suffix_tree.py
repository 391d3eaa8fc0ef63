"""Language-model scores by probabilistic suffix trees.

Texts are read as words. The text tree predicts the class of the next word from the bytes before
it: its contexts are suffixes of what was read (up to ``TEXT_DEPTH`` bytes, a start mark before every
word), its symbols the classes: each of the most frequent words, ``CLASSES`` at most, is its own class, other
words are classed by their last two bytes, and the end of the text is a class. Inside a class words
have their training shares, and what is kept for unseen words follows a spelling tree, which reads a
word's bytes from the last to the first (contexts up to ``SPELL_DEPTH``) and learns from distinct words. So P(text) is the product of P(class | context) P(word | class).

In both trees a context is retained where its next-symbol counts diverge from its suffix's by more
than the description length of its own distribution (likelihood ratio against half a logarithm of
its count per next symbol), together with all its suffixes. Distributions are smoothed with the
suffix's, down to the root, which leaves a share for unseen symbols. A symbol is scored in the
longest state that is a suffix of what was read.

All training words are counted in Spark; every distinct word is scored once, and texts look up their
words: the most frequent ones in a broadcast of at most ``HEAD``, all others by a join. The divergence
test has one threshold at every size. A tree of at most ``MOST`` retained counts is broadcast; a larger one
stays in a written table, its symbols are valued level by level in Spark, and contexts with their symbols
are looked up as words are. Scores do not depend on which of both it is.

Defined results: null and empty texts hold only the end. A null identifier is not held out. Without
training rows all counts are 0 and the trees are their uniform roots. Repeated rows count as often as they stand.
Texts of any length are read whole. An empty table gives an empty result. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import Words, words
from tidemark.llm.common import most_frequent
from tidemark.session import staged

SPELL_DEPTH, SPELL_BITS = 5, 8
TEXT_DEPTH, CLASS_BITS = 3, 17
CLASSES = 1024
HEAD = 262_144
MOST = 1_000_000
START, END, STOP, PAD = 0x20, 0x0A, 0x09, 0x0B  # white space, which no word holds
_ALPHA = 0.5
_SLICE = 4000
_BEGIN = int.from_bytes([PAD, PAD, PAD], "big")  # context of a text's first word
_STOP_CLASS = (1 << CLASS_BITS) - 1


def held_out(ident: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(folds)) == fold, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (hash, word, c, total) from rows (text, held): occurrences in training texts and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                w = words(batch.column("text"))
                h = w.hashes()
                if not len(h):
                    continue
                codes, found = pd.factorize(h)
                trained = np.repeat(~batch.column("held").to_numpy(zero_copy_only=False), w.counts())
                first = np.empty(len(found), np.int64)
                first[codes[::-1]] = np.arange(len(h))[::-1]
                offsets = np.zeros(len(found) + 1, np.int64)
                sizes = w.ends[first] - w.starts[first]
                np.cumsum(sizes, out=offsets[1:])
                take = np.arange(offsets[-1]) + np.repeat(w.starts[first] - offsets[:-1], sizes)
                body = w.data[take]
                names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.view(np.int64)), names.cast(pa.binary()), pa.array(np.bincount(codes, trained, len(found)).astype(np.int64)),
                    pa.array(np.bincount(codes, minlength=len(found)).astype(np.int64)),
                ], names=["hash", "word", "c", "total"])

    local = docs.select("text", "held").mapInArrow(count, "hash long, word binary, c long, total long")
    return local.groupBy("hash", "word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of words: the key (context and next symbol) of every read symbol, the word it is in, and how many were read before in it.

    Words are read from their last byte to their first, so what follows a class (the last two bytes) is read last.
    """
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    body = values.buffers()[2]
    data = (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    # Every word, reversed, stands behind SPELL_DEPTH - 1 pads and its end mark and before its start mark.
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + SPELL_DEPTH + 1, out=out[1:])
    line = np.full(out[-1], PAD, np.uint8)
    line[out[:-1] + SPELL_DEPTH - 1] = END
    line[out[1:] - 1] = START
    at = np.repeat(out[1:] - 2 + offsets[:-1], sizes) - np.arange(len(data))
    line[at] = data
    keys = np.zeros(max(0, len(line) - SPELL_DEPTH), np.uint64)
    for j in range(SPELL_DEPTH + 1):
        keys = (keys << np.uint64(8)) | line[j : len(line) - SPELL_DEPTH + j]
    word = np.repeat(np.arange(len(sizes)), sizes + 1)
    pick = np.arange(len(word)) + word * SPELL_DEPTH
    return keys[pick], word, np.arange(len(word)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)


def count_ngrams(vocabulary: DataFrame) -> DataFrame:
    """Rows (key, n): deepest context and next symbol in one number, over the distinct training words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, found = pd.factorize(_symbols(batch.column("word"))[0])
            n = np.bincount(codes, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    return vocabulary.filter("c > 0").select("word").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def retained(ngrams: DataFrame, depth: int, bits: int) -> DataFrame:
    """Rows (k, ctx, sym, n) of the contexts that pass the divergence test, and of their suffixes."""
    ctx, sym = F.shiftright("key", bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ctx.bitwiseAND(F.lit(_mask(k))).alias("ctx")) for k in range(depth + 1)]))
    counts = staged(ngrams.select(levels.alias("at"), sym.alias("sym"), "n").groupBy("at.k", "at.ctx", "sym").agg(F.sum("n").alias("n")), "pst-counts")
    totals = counts.groupBy("k", "ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    dist = counts.join(totals, ["k", "ctx"])
    above = dist.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("parent"), "sym", (F.col("n") / F.col("all")).alias("q"))
    parent = F.coalesce(*[F.when(F.col("k") == k, F.col("ctx").bitwiseAND(F.lit(_mask(k - 1)))) for k in range(1, depth + 1)])
    gain = dist.filter("k > 0").withColumn("parent", parent).join(above, ["k", "parent", "sym"]).groupBy("k", "ctx").agg(
        F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("q"))).alias("gain"), F.first("all").alias("all"), F.first("kinds").alias("kinds"),
    )
    tested = staged(gain.select("k", "ctx", (F.col("gain") / (0.5 * F.col("kinds") * F.log(F.col("all") + 1))).alias("ratio"), "kinds").filter("ratio > 1"), "pst-tests")
    own = F.explode(F.array(*[
        F.when(F.col("k") >= k, F.struct(F.lit(k).alias("k"), F.col("ctx").bitwiseAND(F.lit(_mask(k))).alias("ctx"))) for k in range(1, depth + 1)
    ]))
    states = tested.select(own.alias("s")).filter("s IS NOT NULL").select("s.*").distinct()
    return staged(counts.join(states, ["k", "ctx"], "left_semi").unionByName(counts.filter("k = 0")), "pst-held")


def log_table(keys: DataFrame, held: DataFrame, depth: int, bits: int) -> DataFrame:
    """Rows (key, lp) of distinct keys: what ``SuffixTree.log10`` gives, for trees of any size.

    From the root down, each level has its own distinct keys, so a context meets at most all symbols
    in a join and a key at most the 256 contexts that are one byte longer.
    """
    low = lambda k: F.col("key").bitwiseAND(F.lit((1 << (8 * k + bits)) - 1))
    cells = held.select("k", F.shiftleft("ctx", bits).bitwiseOR(F.col("sym")).alias("key"), "n")
    root = held.filter("k = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen"), F.count("*").alias("kinds")).first()
    below = root["seen"] + _ALPHA * (root["kinds"] + 1)
    out = keys.select(low(0).alias("key")).distinct().join(cells.filter("k = 0").select("key", "n"), "key", "left").select(
        "key", F.when(F.col("n").isNull(), _ALPHA / below / (1 << bits)).otherwise((F.col("n") + _ALPHA) / below).alias("p"))
    for k in range(1, depth + 1):
        states = held.filter(F.col("k") == k).groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        level = keys.select(low(k).alias("key")).distinct().withColumn("up", low(k - 1)).withColumn("ctx", F.shiftright("key", bits))
        level = level.join(out.withColumnRenamed("key", "up"), "up").join(states, "ctx", "left").join(cells.filter(F.col("k") == k).select("key", "n"), "key", "left")
        out = level.select("key", F.when(F.col("all").isNull(), F.col("p")).otherwise(
            (F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("all") + F.col("kinds"))).alias("p"))
    return out.select("key", F.log10("p").alias("lp"))


def spelled_words(counted: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (hash, spelled): ``SuffixTree.words`` of every distinct word, for trees of any size."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, word, nth = _symbols(batch.column("word"))
            late = nth > 1
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("hash").to_numpy()[word[late]]), pa.array(keys[late].view(np.int64))], names=["hash", "key"])

    # A key occurs in many words, so it is counted once a word and joined as often as words of it are.
    symbols = staged(counted.select("hash", "word").mapInArrow(read, "hash long, key long").groupBy("hash", "key").agg(F.count("*").alias("times")), "pst-symbols")
    values = staged(log_table(symbols.select("key").distinct(), held, SPELL_DEPTH, SPELL_BITS), "pst-spellings")
    return symbols.join(values, "key").groupBy("hash").agg(F.sum(F.col("times") * F.col("lp")).alias("spelled"))


@dataclass
class SuffixTree:
    """Sorted next-symbol keys with log10 probabilities and sorted states with their backing-off weight, by depth."""

    depth: int
    bits: int
    keys: list[np.ndarray]
    values: list[np.ndarray]
    states: list[np.ndarray]
    back: list[np.ndarray]
    unseen: float

    @staticmethod
    def fit(held: pd.DataFrame, depth: int, bits: int) -> SuffixTree:
        k, ctx, sym, n = (held[x].to_numpy() for x in ("k", "ctx", "sym", "n"))
        tree = SuffixTree(depth, bits, [], [], [], [], 0.0)
        root = k == 0
        seen = n[root].sum()
        kinds = int(root.sum())
        # One more symbol stands for all unseen ones together, of which there are fewer than symbols.
        below = seen + _ALPHA * (kinds + 1)
        tree.unseen = float(np.log10(_ALPHA / below / (1 << bits)))
        for level in range(depth + 1):
            here = k == level
            keys = (ctx[here].astype(np.uint64) << np.uint64(bits)) | sym[here].astype(np.uint64)
            order = np.argsort(keys)
            keys, count = keys[order], n[here][order].astype(float)
            if level == 0:
                tree.keys.append(keys)
                tree.values.append(np.log10((count + _ALPHA) / below))
                tree.states.append(np.zeros(1, np.uint64))
                tree.back.append(np.zeros(1))
                continue
            own = keys >> np.uint64(bits)
            edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
            kinds = np.diff(np.append(edges, len(own)))
            all_n = np.add.reduceat(count, edges) if len(edges) else np.zeros(0)
            suffix = tree.log10(keys, level - 1)
            spread = np.repeat(np.stack([kinds, all_n + kinds]), kinds, axis=1) if len(edges) else np.zeros((2, 0))
            tree.keys.append(keys)
            tree.values.append(np.log10((count + spread[0] * 10.0**suffix) / spread[1]) if len(keys) else np.zeros(0))
            tree.states.append(own[edges])
            tree.back.append(np.log10(kinds / (all_n + kinds)) if len(edges) else np.zeros(0))
        return tree

    def log10(self, keys: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Log-probability of each key's symbol in the longest state that its context ends with."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for d in range(self.depth if depth is None else depth, -1, -1):
            key = keys[todo] & np.uint64((1 << (8 * d + self.bits)) - 1)
            if len(self.keys[d]):
                at = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
                hit = self.keys[d][at] == key
                out[todo[hit]] += self.values[d][at[hit]]
                todo, key = todo[~hit], key[~hit]
            if d and len(self.states[d]):
                own = key >> np.uint64(self.bits)
                at = np.minimum(np.searchsorted(self.states[d], own), len(self.states[d]) - 1)
                hit = self.states[d][at] == own
                out[todo[hit]] += self.back[d][at[hit]]
        out[todo] += self.unseen
        return out

    def words(self, column: pa.Array) -> np.ndarray:
        """Log-probability of every word's spelling, given its last two bytes."""
        keys, word, read = _symbols(column)
        codes, found = pd.factorize(keys)
        return np.bincount(word, np.where(read > 1, self.log10(found)[codes], 0.0), len(column))


def _classes_of(w: Words, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every word and the context it leaves for the next one."""
    h, size = w.hashes().view(np.int64), w.ends - w.starts
    byte = lambda back: np.where(size >= back, w.data[np.maximum(w.ends - back, 0)], np.where(size + 1 == back, START, PAD)).astype(np.int64)
    tail = byte(2) << 8 | byte(1)
    own = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
    hit = frequent[own] == h if len(frequent) else np.zeros(len(h), bool)
    return np.where(hit, (1 << 16) + own, tail), byte(3) << 16 | tail


def _text_keys(w: Words, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and class of every word, and of every text's end behind all words; the first of a text in each."""
    classes, leaves = _classes_of(w, frequent)
    before = np.empty(len(classes), np.int64)
    before[1:] = leaves[:-1]
    some = w.first[:-1][w.counts() > 0]
    before[some] = _BEGIN
    last = np.full(len(w.first) - 1, _BEGIN, np.int64)
    last[w.counts() > 0] = leaves[w.first[1:][w.counts() > 0] - 1]
    return before << CLASS_BITS | classes, last << CLASS_BITS | _STOP_CLASS


def count_classes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Rows (key, n): context and class of every word and end of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pd.Series(np.concatenate(_text_keys(words(part.column("text")), frequent))).value_counts(sort=False)
                     for part in (batch.slice(at, _SLICE) for at in range(0, batch.num_rows, _SLICE))]
            for f in found:
                yield pa.RecordBatch.from_arrays([pa.array(f.index.to_numpy()), pa.array(f.to_numpy())], names=["key", "n"])

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def score(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: identifier, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = df.sparkSession
    send = spark.sparkContext.broadcast
    docs = df.select(F.col(ident).alias("id"), held_out(F.col(ident)).alias("held"), F.col(text).alias("text"))
    counted = staged(count_words(docs), "pst-words")
    ends = docs.filter("NOT held").count()
    sums = counted.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    frequent = most_frequent(counted.filter("c > 0"), "c", CLASSES).select("hash").toArrow().to_pandas()["hash"].sort_values().to_numpy(np.int64)

    def tree(held: DataFrame, depth: int, bits: int) -> SuffixTree | None:
        return SuffixTree.fit(held.toArrow().to_pandas(), depth, bits) if held.count() <= MOST else None

    spells = retained(staged(count_ngrams(counted), "pst-ngrams"), SPELL_DEPTH, SPELL_BITS)
    steps = retained(staged(count_classes(docs.filter("NOT held"), frequent), "pst-ngrams"), TEXT_DEPTH, CLASS_BITS)
    spelling, texts = send(tree(spells, SPELL_DEPTH, SPELL_BITS)), send(tree(steps, TEXT_DEPTH, CLASS_BITS))
    few_spells, few_steps = spelling.value is not None, texts.value is not None
    graded_words = counted.withColumn("spelled", F.lit(0.0)) if few_spells else counted.join(spelled_words(counted, spells), "hash", "left").withColumn("spelled", F.coalesce("spelled", F.lit(0.0)))
    far_steps, near_steps = None, send((np.zeros(0, np.int64), np.zeros(0)))
    if not few_steps:
        read = staged(count_classes(docs, frequent), "pst-read")
        far_steps = staged(read.join(log_table(read.select("key"), steps, TEXT_DEPTH, CLASS_BITS), "key"), "pst-steps")
        most = most_frequent(far_steps, "n", HEAD).toArrow().to_pandas().sort_values("key")
        near_steps = send((most["key"].to_numpy(np.int64), most["lp"].to_numpy(float)))
    # Words and occurrences of each class of rarer words; a class is two bytes.
    last_two = F.when(F.length("word") > 1, F.substring("word", -2, 2)).otherwise(F.concat(F.lit(bytes([START])), F.col("word")))
    rare = counted.filter("c > 0").filter(~F.col("hash").isin([int(x) for x in frequent]))
    kinds = rare.groupBy(last_two.alias("class")).agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).toArrow().to_pandas()
    class_all, class_kinds = np.zeros(1 << 16), np.zeros(1 << 16)
    at = [int.from_bytes(x, "big") for x in kinds["class"]]
    class_all[at], class_kinds[at] = kinds["all"], kinds["kinds"]
    classes = send((frequent, class_all, class_kinds))
    floor = float(np.log10(n + v + 1))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_n, all_kinds = classes.value
        for batch in batches:
            c, h = batch.column("c").to_numpy(), batch.column("hash").to_numpy()
            spelled = 10.0 ** (spelling.value.words(batch.column("word")) if few_spells else batch.column("spelled").to_numpy())
            at = np.array([int.from_bytes(x[-2:] if len(x) > 1 else bytes([START]) + x, "big") for x in batch.column("word").to_pylist()], np.int64)
            share = (c + all_kinds[at] * spelled) / np.maximum(all_n[at] + all_kinds[at], 1)
            share = np.where(all_kinds[at] > 0, share, spelled)
            inside = np.where(np.isin(h, own), 0.0, np.log10(np.maximum(share, 1e-300)))
            yield pa.RecordBatch.from_arrays([
                batch.column("hash"), batch.column("total"), pa.array(c > 0), pa.array(np.log10(c + 1.0) - floor), pa.array(inside),
            ], names=["hash", "total", "known", "base", "score"])

    graded = staged(graded_words.select("hash", "word", "c", "total", "spelled").mapInArrow(grade, "hash long, total long, known boolean, base double, score double"), "pst-graded")
    top = most_frequent(graded, "total", HEAD).toArrow().to_pandas().sort_values("hash")
    head = send(tuple(top[x].to_numpy() for x in ("hash", "known", "base", "score")))
    end_known, end_base = int(ends > 0), float(np.log10(ends + 1) - floor)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known, base, good = head.value
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                w = words(batch.column("text"))
                h, sizes = w.hashes().view(np.int64), w.counts()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                add = lambda x: np.bincount(doc[hit], x[place[hit]], len(sizes))
                inner, stop = _text_keys(w, classes.value[0])
                if few_steps:
                    codes, found = pd.factorize(np.concatenate((inner, stop)))
                    step = texts.value.log10(found.view(np.uint64))[codes]
                    context = np.bincount(doc, step[: len(doc)], len(sizes)) + step[len(doc) :]
                    far, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    far, owner = np.concatenate((inner, stop)), np.concatenate((doc, np.arange(len(sizes))))
                    known_keys, values = near_steps.value
                    near = np.minimum(np.searchsorted(known_keys, far), max(0, len(known_keys) - 1))
                    there = known_keys[near] == far if len(known_keys) else np.zeros(len(far), bool)
                    context = np.bincount(owner[there], values[near[there]], len(sizes))
                    order = np.flatnonzero(~there)
                    order = order[np.argsort(owner[order], kind="stable")]
                    far, owner = far[order], owner[order]
                ahead = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(np.bincount(owner, minlength=len(sizes)), out=ahead[1:])
                rest = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(np.bincount(doc[~hit], minlength=len(sizes)), out=rest[1:])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("held"), pa.array(sizes + 1), pa.array(add(known).astype(np.int64) + end_known),
                    pa.array(add(base) + end_base), pa.array(add(good) + context), pa.ListArray.from_arrays(pa.array(rest), pa.array(h[~hit])),
                    pa.ListArray.from_arrays(pa.array(ahead), pa.array(far)),
                ], names=["id", "held", "n_tokens", "n_known", "base", "score", "rest", "far"])

    kind = dict(docs.dtypes)["id"]
    partial = staged(docs.mapInArrow(look_up, f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double, rest array<long>, far array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "pst-docs")
    tail = partial.select("row", F.explode("rest").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("n"))
    more = tail.join(graded.drop("total"), "hash").groupBy("row").agg(
        F.sum(F.col("n") * F.col("known").cast("long")).alias("k2"), F.sum(F.col("n") * F.col("base")).alias("b2"), F.sum(F.col("n") * F.col("score")).alias("s2"),
    )
    slim = partial.drop("rest", "far")
    if far_steps is not None:
        rare_steps = partial.select("row", F.explode("far").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        sums = rare_steps.join(far_steps, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("lp")).alias("far"))
        slim = slim.join(sums, "row", "left").withColumn("score", F.col("score") + F.coalesce("far", F.lit(0.0)))
    return slim.join(more, "row", "left").select(
        F.col("id").alias(ident), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b2", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"),
    )
