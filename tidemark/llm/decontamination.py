"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The words of all test items are the letters of one suffix automaton. Training texts stream through it
word by word, and at every word it tells the longest run of words that ends there and occurs in some
item. Where that run reaches ``window`` words, a window of an item ends, and its words are hit. Items
of fewer words are one window each: their states are linked from the states they are suffixes of. The
state of the last ``window`` words names the items that hold them.

Most of a text is never streamed. A bitmap of hashes of the items' runs of ``probe`` words tells in
numpy where at least so many words of an item stand in a row; the automaton starts anew at each such
stretch, which is as long as any match inside it.

Test items reach the tasks in parts of at most ``PART_WORDS`` words (an item that is longer is cut into
pieces that overlap by ``window`` - 1 words), so the automaton is bounded; a larger test set takes one
pass over the texts for each part, and the spans of a document are united afterwards.

``find`` gives what was hit. ``clean`` takes hit spans longer than a limit out of the texts, and
whole documents whose share of hit words is above another.

Defined results: null texts, empty ones and those without words are not hit. Null items and items
without words have no window; an item without an identifier hits words, but is not among the items
named; of repeated identifiers one is counted. Texts of any length are read whole. Repeated documents
are judged one by one. Without items nothing is hit; without documents the result is empty. Extra
columns are carried by ``clean``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytewords import MARKS, Words, mix, raw, words
from tidemark.llm.common import ascii_lower
from tidemark.session import staged

WINDOW = 10
PART_WORDS = 200_000  # words in one automaton, which has at most twice as many states
PROBE = 3
_SLICE = 1000
_STEP = 0x9E3779B97F4A7C15
# Fixed value: what is a word, here as for the byte table MARKS.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass
class SuffixAutomaton:
    """Suffix automaton of several word sequences; every state stands for runs that end at the same places."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, letter: int) -> int:
        """The state of p's longest run and the letter; a clone where the present one stands for longer runs too."""
        q = self.step[p][letter]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(letter) == q:
            self.step[p][letter] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, letter: int) -> int:
        """Adds a letter behind the run of state ``last``, which is 0 at the start of a sequence."""
        if letter in self.step[last]:
            return self._split(last, letter)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and letter not in self.step[p]:
            self.step[p][letter] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, letter)
        return new

    def matches(self, letters: list[int]) -> Iterator[tuple[int, int]]:
        """After every letter: the state and the length of the longest run that ends there and occurs in the sequences."""
        at, size = 0, 0
        step, link, length = self.step, self.link, self.length
        for x in letters:
            while at and x not in step[at]:
                at = link[at]
                size = length[at]
            to = step[at].get(x)
            if to is not None:
                at, size = to, size + 1
            yield at, size


class Matcher:
    """The automaton of a part of the test items, and what its states mean for windows."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window, self.sam, self.numbers = window, SuffixAutomaton(), {}
        sam, ends, spans = self.sam, [], []
        for ident, item in items:
            letters = [self.numbers.setdefault(w.encode(), len(self.numbers)) for w in item]
            if letters:
                spans.append((ident, letters))
                last = 0
                for x in letters:
                    last = sam.extend(last, x)
                if len(letters) < window:
                    ends.append((last, len(letters), ident))
        order = np.argsort(np.array(sam.length), kind="stable").tolist()
        #: The state of the last ``window`` words of a state's runs; of no use in states of shorter runs.
        self.tail = list(range(len(order)))
        #: Short items that are a run of the state, and the next state among its suffixes that has some.
        self.short: dict[int, list[tuple[int, object]]] = {}
        for state, n, ident in ends:
            self.short.setdefault(state, []).append((n, ident))
        self.next_short = [-1] * len(order)
        for s in order[1:]:
            up = sam.link[s]
            if sam.length[up] >= window:
                self.tail[s] = self.tail[up]
            self.next_short[s] = up if up in self.short else self.next_short[up]
        #: Items by the state of a window, found by streaming the items themselves.
        self.holders: dict[int, set] = {}
        for ident, letters in spans:
            for at, size in sam.matches(letters):
                if size >= window:
                    self.holders.setdefault(self.tail[at], set()).add(ident)
        self.least = min((min(len(x), window) for _, x in spans), default=0)
        self.probe = min(PROBE, self.least) or 1
        self.bits = max(12, 6 + sum(len(x) for _, x in spans).bit_length())  # under one place in 32 is taken
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        if spans:
            w = words(pa.array([" ".join(item) for _, item in items]), MARKS)
            self.bitmap[self._probes(w)[0]] = True

    def _probes(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Bitmap places of all runs of ``probe`` words inside a text, and the words these start at."""
        h = w.hashes()
        run = np.zeros(len(h), np.uint64)
        for j in range(self.probe):
            m = max(0, len(h) - j)
            run[:m] = run[:m] * np.uint64(_STEP) + h[j : j + m]
        inside = np.ones(len(h), dtype=bool)
        for j in range(1, self.probe):
            inside[np.maximum(w.first[1:] - j, w.first[:-1])[w.counts() > 0]] = False
        at = np.flatnonzero(inside)
        return (mix(run[at]) >> np.uint64(64 - self.bits)).astype(np.int64), at

    def stretches(self, w: Words) -> list[tuple[int, int]]:
        """Ranges of words of single texts outside which no run of ``least`` words of an item begins or ends."""
        places, at = self._probes(w)
        known = at[self.bitmap[places]]
        if not len(known):
            return []
        owner = np.searchsorted(w.first, known, side="right")
        cut = np.flatnonzero((np.diff(known) != 1) | (np.diff(owner) != 0)) + 1
        begins, stops = known[np.concatenate(([0], cut))], known[np.concatenate((cut - 1, [len(known) - 1]))] + self.probe
        enough = stops - begins >= self.least
        return list(zip(begins[enough].tolist(), stops[enough].tolist(), strict=True))

    def hits(self, w: Words) -> tuple[list[tuple[int, int]], dict[int, set]]:
        """Hit spans of words, in order and apart from each other, and the items found by the number of the text."""
        spans, items = [], {}
        lookup = self.numbers.get
        for a, b in self.stretches(w):
            letters = [lookup(w.word(i), -1) for i in range(a, b)]
            found: set = set()
            doc = int(np.searchsorted(w.first, a, side="right")) - 1
            head = int(w.first[doc])
            for i, (at, size) in enumerate(self.sam.matches(letters), a + 1):
                reach = 0
                if size >= self.window:
                    reach = self.window
                    found |= self.holders[self.tail[at]]
                node = at if at in self.short else self.next_short[at]
                while node > 0:
                    for n, ident in self.short[node]:
                        if n <= size:
                            reach = max(reach, n)
                            found.add(ident)
                    node = self.next_short[node]
                if reach:
                    begin = i - reach
                    while spans and spans[-1][0] >= head and spans[-1][1] >= begin:  # stretches may overlap as well
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i))
            if found:
                items.setdefault(doc, set()).update(found)
        return spans, items


def item_pieces(benchmark: DataFrame, ident: str, text: str, window: int) -> tuple[DataFrame, int]:
    """Rows (id, ws, part) and the number of parts: words of the items, long ones in overlapping pieces, dealt to parts of at most ``PART_WORDS`` words."""
    longest = max(window, PART_WORDS // 16)
    ws = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(WORD_PATTERN), F.lit(0))
    rows = benchmark.select(F.col(ident).cast("string").alias("id"), ws.alias("ws")).filter(F.size("ws") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1), F.lit(longest))
    cut = staged(rows.select("id", "ws", F.explode(begins).alias("at")).select("id", F.slice("ws", F.col("at"), F.lit(longest + window - 1)).alias("ws")).distinct(), "test-items")
    parts, n = 1, F.sum(F.size("ws"))
    while True:
        dealt = cut.withColumn("part", F.pmod(F.xxhash64("id", "ws"), F.lit(parts)))
        if (dealt.groupBy("part").agg(n.alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= PART_WORDS:
            return dealt, parts
        parts *= 2


def find(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Per document ``row`` (all columns, or those of ``carry``), ``n_words``, the hit ``spans`` and the ``items`` found, sorted as strings.

    Spans are in order and apart from each other: first word and the one behind the last, first byte and the one behind the last.
    """
    pieces, parts = item_pieces(benchmark, item, item_text, window)
    own = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(text).alias("body"))
    if parts == 1:
        return _stream(own, pieces, window, "row")
    own = staged(own.withColumn("at", F.monotonically_increasing_id()), "decontaminate-input")
    seen = None
    for part in range(parts):
        hit = staged(_stream(own, pieces.filter(F.col("part") == part), window, "at").filter(F.size("spans") > 0), "decontaminate-hits")
        seen = hit if seen is None else seen.unionByName(hit)
    # Spans of one document that meet are one: the greatest end so far tells where a new one begins.
    order = Window.partitionBy("at").orderBy("first_word", "end_word")
    spans = seen.select("at", F.explode("spans").alias("s")).select("at", "s.*")
    fresh = F.when(F.col("first_word") <= F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("at", "run").agg(*[F.min(c).alias(c) if c.startswith("first") else F.max(c).alias(c) for c in SPAN])
    united = merged.groupBy("at").agg(F.sort_array(F.collect_list(F.struct(*SPAN))).alias("spans"))
    names = seen.select("at", F.explode("items").alias("i")).groupBy("at").agg(F.sort_array(F.collect_set("i")).alias("items"))
    n_words = F.size(F.regexp_extract_all(ascii_lower(F.coalesce("body", F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))).cast("long")
    found = own.select("row", "at", n_words.alias("n_words")).join(united, "at", "left").join(names, "at", "left")
    nothing = F.array()
    return found.select("row", "n_words", *[F.coalesce(c, nothing.cast(k)).alias(c) for c, k in (("spans", SPANS), ("items", "array<string>"))])


SPAN = ("first_word", "end_word", "first_byte", "end_byte")
SPANS = f"array<struct<{','.join(f'{n}:bigint' for n in SPAN)}>>"

_matchers: dict[tuple, Matcher] = {}


def _stream(base: DataFrame, pieces: DataFrame, window: int, kept: str) -> DataFrame:
    """One pass of the texts through the automaton of one part of the items."""
    items = [(r["id"], r["ws"]) for r in pieces.select("id", "ws").collect()]
    shared = base.sparkSession.sparkContext.broadcast(items)  # at most PART_WORDS words
    key = uuid.uuid4().hex
    span_type = pa.list_(pa.struct([(n, pa.int64()) for n in SPAN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:  # one automaton serves all tasks of a worker
            _matchers.clear()
            _matchers[key] = Matcher(shared.value, window)
        matcher = _matchers[key]
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                w = words(batch.column("body"), MARKS)
                bytes_before = raw(batch.column("body"))[1]
                spans, items = matcher.hits(w)
                by_doc: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
                for a, b in spans:
                    doc = int(np.searchsorted(w.first, a, side="right")) - 1
                    head, zero = int(w.first[doc]), int(bytes_before[doc])
                    by_doc[doc].append((a - head, b - head, int(w.starts[a]) - zero, int(w.ends[b - 1]) - zero))
                names = [sorted(i for i in items.get(d, ()) if i is not None) for d in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(kept), pa.array(w.counts(), pa.int64()), pa.array(by_doc, span_type), pa.array(names, pa.list_(pa.string()))],
                    names=[kept, "n_words", "spans", "items"])

    kind = base.schema[kept].dataType.simpleString()
    return base.select(kept, "body").mapInArrow(run, f"`{kept}` {kind}, n_words long, spans {SPANS}, items array<string>")


def digest(found: DataFrame, ident: str) -> DataFrame:
    """Per document: identifier, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(
        F.col(f"row.{ident}").alias(ident), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 0, most_share: float = 0.5,
    text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents without hit spans of more than ``most_words`` words; those with a larger share of hit words than ``most_share`` go.

    A span goes from its first to its last word; what stood around it stays, as does everything in documents that were not hit.
    """
    found = find(docs, benchmark, window, text, item, item_text)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    kept = found.filter(hit <= F.col("n_words") * most_share)
    body, away = F.encode(F.col(f"row.{text}"), "UTF-8"), F.filter("spans", lambda s: s["end_word"] - s["first_word"] > most_words)
    # What stands between the spans, before the first and behind the last.
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(away, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(away, lambda s: s["first_byte"]), F.array(F.octet_length(body).cast("long")))
    between = F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(body, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    left = F.when(F.size(away) > 0, F.array_join(between, "")).otherwise(F.col(f"row.{text}"))
    names = found.schema["row"].dataType.names
    return kept.select(*[(left if c == text else F.col("row")[c]).alias(c) for c in names])
