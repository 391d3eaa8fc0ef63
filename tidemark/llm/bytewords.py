"""Words of many texts at once: spans and 64-bit hashes over one byte buffer, in numpy.

A word is a maximal run of bytes other than space and 0x09 to 0x0D, after A-Z were lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Everything of ASCII but digits and lower-case letters parts words of the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` kind.
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

# An odd multiplier has an inverse modulo 2^64, so a word's hash does not depend on where it stands.
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_HASH_BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        grown = np.full(max(size, _HASH_BLOCK + 4096), base, dtype=np.uint64)
        grown[0] = 1
        _powers[base] = have = np.multiply.accumulate(grown)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (a bijection on 64 bits)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # folded bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of the first word of every text; one more entry than texts

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _HASH_BLOCK, side="right")))
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            span = int(e[-1])
            up, down = _power_table(_STEP, span + 1), _power_table(_BACK, span + 1)
            sums = np.zeros(span + 1, dtype=np.uint64)
            np.cumsum((self.data[base : base + span].astype(np.uint64) + np.uint64(1)) * up[:span], out=sums[1:])
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, parting: np.ndarray = _BLANK) -> Words:
    """Words of every text; ``parting`` tells for each byte whether it stands between words."""
    data, offsets = raw(column)
    data = _FOLD[data]
    solid = ~parting[data]
    begins, stops = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = solid[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        stops[tails] = solid[tails]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[edges], np.diff(np.append(edges, len(values)))
