"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads the text once; at every position the output links
give the pieces that end there and relax the best score of a segmentation up to it (Viterbi). The
best path gives the piece ids. White space is part of the pieces: a blank is put before the text,
and no piece holds a blank after another character, so a text's words (each with the blanks before
it) are encoded independently and equal words only once per worker. The new words of a slice of texts
go through the automaton side by side, character after character, in numpy. With a word's ids its bytes,
decoded from these ids, are kept, so checking the round trip of a text is joining them.

The registered model (``MODEL``) is a BPE model, whose scores are merge ranks. The Viterbi takes the
segmentation with the greatest sum of them, as for a unigram model; the library merges pairs by rank
instead, so its ids can differ on this model (README has the share). On unigram models the ids are equal.

Characters in no piece become the pieces of their UTF-8 bytes, or the unknown piece where the model
has none. Scores are the model's own.

Defined results: null and empty texts have no pieces and decode to the empty text. Texts of any
length are encoded whole; a word's cost is linear in its length. The word cache is emptied before it
grows over ``CACHE`` words, which changes no result. Of equally good segmentations the one whose last
piece is longest is taken, at every position. The sign U+2581, with which models write the blank,
is spelled in bytes, so decoding gives back every text unless the unknown piece was needed. Repeated rows are
encoded alike. An empty table gives an empty result. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import giving_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CACHE = 60_000
UNKNOWN_PENALTY = 10.0
LONGEST = 64  # letters of a word up to which it is encoded beside others
SIDE_BY_SIDE = 4096
_WORDS = re.compile(r" *[^ ]+| +")


@dataclass(frozen=True)
class PieceModel:
    """The pieces of a model file, read on the driver and sent along with the job (tens of thousands of strings)."""

    pieces: tuple[tuple[str, float, int], ...]  # text with plain blanks, score, id
    byte_ids: tuple[int, ...]  # ids of the 256 byte pieces, or empty
    unknown: int
    decode_table: tuple[bytes, ...]
    words_apart: bool

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces, bytes_of, decode = [], {}, []
        for i in range(sp.vocab_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_of[int(name[3:5], 16)] = i
                decode.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                decode.append(b"")
            elif sp.is_unknown(i):
                decode.append(" ⁇ ".encode())
            else:
                text = name.replace(BLANK, " ")
                pieces.append((text, sp.get_score(i), i))
                decode.append(text.encode())
        return PieceModel(
            tuple(pieces), tuple(bytes_of[b] for b in range(256)) if len(bytes_of) == 256 else (), sp.unk_id(), tuple(decode),
            all(" " not in text.lstrip(" ") for text, _, _ in pieces),
        )


@dataclass
class PieceAutomaton:
    """Aho-Corasick automaton; a state's output link leads to the next shorter piece that ends there."""

    model: PieceModel
    step: list[dict[str, int]] = field(default_factory=lambda: [{}])
    fail: list[int] = field(default_factory=lambda: [0])
    ends: list[tuple[int, float, int] | None] = field(default_factory=lambda: [None])  # length, score, id
    link: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for text, score, ident in self.model.pieces:
            at = 0
            for ch in text:
                to = self.step[at].get(ch)
                if to is None:
                    to = self.step[at][ch] = len(self.step)
                    self.step.append({})
                    self.fail.append(0)
                    self.ends.append(None)
                    self.link.append(0)
                at = to
            if at and (self.ends[at] is None or score > self.ends[at][1]):
                self.ends[at] = (len(text), score, ident)
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            for ch, to in self.step[at].items():
                back = self.fail[at]
                while back and ch not in self.step[back]:
                    back = self.fail[back]
                back = self.step[back].get(ch, 0)
                self.fail[to] = back if back != to else 0
                self.link[to] = self.fail[to] if self.ends[self.fail[to]] else self.link[self.fail[to]]
                queue.append(to)
        self._freeze()
        self.single = {text for text, _, _ in self.model.pieces if len(text) == 1}
        self.unknown_score = min((s for _, s, _ in self.model.pieces), default=0.0) - UNKNOWN_PENALTY

    def _freeze(self) -> None:
        """The automaton as arrays: edges sorted by state and letter, and what states output."""
        letters = sorted({ch for step in self.step for ch in step})
        number = {ch: i for i, ch in enumerate(letters)}
        self.letters = np.array([ord(ch) for ch in letters], dtype=np.uint32)
        edges = sorted((at * len(letters) + number[ch], to) for at, step in enumerate(self.step) for ch, to in step.items())
        self.edges, self.targets = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        self.fails, self.links = np.array(self.fail), np.array(self.link)
        self.sizes, self.scores, self.idents = (np.array([end[k] if end else 0 for end in self.ends], kind) for k, kind in ((0, np.int64), (1, np.float64), (2, np.int64)))
        table = self.model.decode_table
        self.body = np.frombuffer(b"".join(table), np.uint8)
        self.body_size = np.array([len(t) for t in table], dtype=np.int64)
        self.body_start = np.cumsum(self.body_size) - self.body_size
        self.alone = np.zeros(len(letters) + 1, dtype=bool)  # letters that are pieces; the last place stands for letters in no piece
        self.alone[[number[text] for text, _, _ in self.model.pieces if len(text) == 1]] = True

    def _advance(self, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """States after one more letter each."""
        out = np.zeros_like(at)
        open_ = np.flatnonzero(letter < len(self.letters)) if len(self.edges) else np.zeros(0, np.int64)
        at = at[open_]
        while len(open_):
            key = at * len(self.letters) + letter[open_]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[place] == key
            out[open_[found]] = self.targets[place[found]]
            again = ~found & (at > 0)
            open_, at = open_[again], self.fails[at[again]]
        return out

    def best_paths(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of the best path of every word and the bytes they decode to, all words side by side."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        codes = np.frombuffer("".join(words[i] for i in order.tolist()).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(size) - size
        letter = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        letter[self.letters[letter] != codes if len(self.letters) else slice(None)] = len(self.letters)
        best = np.zeros((int(size[0]) + 1, len(words)))
        took = np.zeros(best.shape, dtype=np.int32)
        at = np.zeros(len(words), dtype=np.int64)
        for i in range(1, len(best)):
            n = int(np.searchsorted(-size, -i, side="right"))  # words of at least i letters
            now = letter[begin[:n] + i - 1]
            at = self._advance(at[:n], now)
            top = np.full(n, -np.inf)
            node, word = np.where(self.sizes[at] > 0, at, self.links[at]), np.arange(n)
            while True:  # output links, from the longest piece to the shortest
                live = node > 0
                node, word = node[live], word[live]
                if not len(node):
                    break
                value = best[i - self.sizes[node], word] + self.scores[node]
                better = value > top[word]
                top[word[better]], took[i, word[better]] = value[better], node[better]
                node = self.links[node]
            unknown = ~self.alone[now] & (best[i - 1, :n] + self.unknown_score > top)
            top[unknown], took[i, :n][unknown] = (best[i - 1, :n] + self.unknown_score)[unknown], 0
            best[i, :n] = top
        word, left, ids, owners = np.arange(len(words)), size.copy(), [], []
        while len(word):
            node = took[left[word], word]
            # A letter in no piece leaves its code, below the ids.
            ids.append(np.where(node > 0, self.idents[node], -1 - codes[begin[word] + left[word] - 1].astype(np.int64)))
            owners.append(word)
            left[word] -= np.maximum(self.sizes[node], 1)
            word = word[left[word] > 0]
        flat, owner = np.concatenate(ids)[::-1], np.concatenate(owners)[::-1]
        forward = np.argsort(owner, kind="stable")
        flat, ends = flat[forward], np.cumsum(np.bincount(owner, minlength=len(words)))
        body, upto = self._decoded(flat)
        packed, cuts, stops = flat.astype(np.int32).tobytes(), ends.tolist(), upto[ends].tolist()
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(words)
        for to, a, b, c, d in zip(order.tolist(), [0, *cuts[:-1]], cuts, [0, *stops[:-1]], stops, strict=True):
            out[to] = packed[4 * a : 4 * b], body[c:d]
        for i in np.unique(owner[forward][flat < 0]).tolist():  # letters in no piece are spelled in bytes
            a, b = ends[i - 1] if i else 0, ends[i]
            spelled: list[int] = []
            for x in flat[a:b].tolist():
                spelled += [x] if x >= 0 else self.spelled(chr(-1 - x))
            out[order[i]] = np.array(spelled, dtype=np.int32).tobytes(), b"".join(map(self.model.decode_table.__getitem__, spelled))
        return out

    def _decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of pieces, one after the other (nothing for other numbers), and where those of each begin and end."""
        known = np.maximum(ids, 0)
        size = np.where(ids >= 0, self.body_size[known], 0)
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.body[np.arange(ends[-1]) + np.repeat(self.body_start[known] - ends[:-1], size)].tobytes(), ends

    def spelled(self, letter: str) -> list[int]:
        """Ids of a letter in no piece: its bytes, or the unknown piece where the model has no bytes."""
        return [self.model.byte_ids[b] for b in letter.encode()] if self.model.byte_ids else [self.model.unknown]

    def best_path(self, text: str) -> list[int]:
        step, fail, ends, link = self.step, self.fail, self.ends, self.link
        best = [0.0] + [float("-inf")] * len(text)
        took: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
        at = 0
        for i, ch in enumerate(text, 1):
            while at and ch not in step[at]:
                at = fail[at]
            at = step[at].get(ch, 0)
            top, choice = float("-inf"), None
            node = at if ends[at] else link[at]
            while node:  # output links, from the longest piece to the shortest
                size, score, ident = ends[node]
                value = best[i - size] + score
                if value > top:
                    top, choice = value, (size, ident)
                node = link[node]
            if ch not in self.single:
                value = best[i - 1] + self.unknown_score
                if value > top:
                    top, choice = value, (1, -1)
            best[i], took[i] = top, choice
        out, i = [], len(text)
        while i:
            size, ident = took[i]
            if ident >= 0:
                out.append(ident)
            else:
                out.extend(reversed(self.spelled(text[i - 1])))
            i -= size
        return out[::-1]


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.automaton = PieceAutomaton(model)
        self.ids_of: dict[str, bytes] = {}  # packed ids of a word
        self.bytes_of: dict[str, bytes] = {}  # the bytes these ids decode to

    def _learn(self, words: set[str]) -> None:
        """Adds words that are not known yet."""
        short = [w for w in words if len(w) <= LONGEST]
        for at in range(0, len(short), SIDE_BY_SIDE):
            part = short[at : at + SIDE_BY_SIDE]
            for w, (ids, body) in zip(part, self.automaton.best_paths(part), strict=True):
                self.ids_of[w], self.bytes_of[w] = ids, body
        for w in words:
            if len(w) > LONGEST:
                ids = self.automaton.best_path(w)
                self.ids_of[w], self.bytes_of[w] = np.array(ids, dtype=np.int32).tobytes(), self._bytes(ids)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of every text its packed ids and the UTF-8 bytes they decode to, the blank put before it included."""
        if not self.model.words_apart:
            done = [self.automaton.best_path(" " + t) if t else [] for t in texts]
            return [(np.array(p, dtype=np.int32).tobytes(), self._bytes(p)) for p in done]
        words = [_WORDS.findall(" " + t) if t else [] for t in texts]
        needed = set().union(*words)
        new = needed.difference(self.ids_of)
        if len(self.ids_of) + len(new) > CACHE:
            self.ids_of, self.bytes_of = ({w: d[w] for w in needed - new} for d in (self.ids_of, self.bytes_of))
        self._learn(new)
        out = [(b"".join(map(self.ids_of.__getitem__, own)), b"".join(map(self.bytes_of.__getitem__, own))) for own in words]
        if len(self.ids_of) > CACHE:  # texts with more words than that
            self.ids_of, self.bytes_of = {}, {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0][0]

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.model.decode_table.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the text; the blank put before it goes."""
        whole = self._bytes(ids)
        return whole[1:] if whole[:1] == b" " else whole


_codecs: dict[int, Codec] = {}


def codec(model: PieceModel) -> Codec:
    """The worker's codec of a model; building the automaton once serves all its tasks."""
    key = hash((model.pieces[:64], len(model.pieces), model.unknown, model.byte_ids))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _shared(df: DataFrame, model: PieceModel):
    return df.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary


def encode(df: DataFrame, model: PieceModel, text: str = "text", verify: bool = False) -> DataFrame:
    """Adds to the input ``row`` its ``piece_ids``; with ``verify`` also ``round_trip``, whether decoding them gives the text."""
    base = df.select(F.struct("*").alias("row"))
    schema = T.StructType([base.schema["row"], T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *([T.StructField("round_trip", T.BooleanType())] if verify else [])])
    shared = _shared(df, model)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("row").field(text).to_pylist()]
                done = c.encode_all(texts)
                packed = [p for p, _ in done]
                offsets = np.zeros(len(packed) + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                out = [batch.column("row"), lists]
                if verify:
                    same = [whole == (b" " + t.encode() if t else b"") for (_, whole), t in zip(done, texts, strict=True)]
                    out.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, model: PieceModel, ids: str = "piece_ids") -> DataFrame:
    """Adds to the input ``row`` its ``decoded`` text; null ids give the empty text, bytes that are no UTF-8 the replacement sign."""
    base = df.select(F.struct("*").alias("row"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([base.schema["row"], T.StructField("decoded", T.StringType())])
    shared = _shared(df, model)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [c.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    return base.mapInArrow(run, schema)
