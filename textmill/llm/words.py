"""Words of Arrow text batches as flat numpy arrays.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``.  Words are found on the UTF-8
bytes of a whole batch at once and never cross a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows are worked on in slices of about this many bytes of text (a longer row is a slice of its own).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _tables[base] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some rows: byte range, row number and 64-bit hash of each, in text order."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def first(self) -> np.ndarray:
        """Index of each row's first word, with the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1), side="left")

    def hashes(self, base: int = _BYTE_BASE) -> np.ndarray:
        power, inverse = _powers(base, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])


def grams(word_hashes: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """64-bit hashes of every k words in a row; the caller drops those that cross rows."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(base, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hashes * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if not len(text):
        return
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, len(text))
        own = offsets[a : b + 1]
        yield a, b, data[own[0] : own[-1]], own - own[0]
        a = b


#: Bytes outside letters and digits, where every byte beyond ASCII is taken for part of a letter.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words of rows laid end to end in data; between: which bytes stand between words."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~between[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, row)


def batches(text: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in slices(text, limit):
        yield a, b, split(data, offsets, lower)
