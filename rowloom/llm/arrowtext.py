"""Vectorised views of text columns: words and their hashes straight from Arrow buffers.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``, within one text.
Texts are handled in slices of about a megabyte, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Some consecutive texts: ``data`` holds their bytes, text i from ``offsets[i]`` to ``offsets[i+1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about ``limit`` bytes; nulls become empty texts, marked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], null[at:to])
        at = to


@dataclass
class Words:
    """Words of a slice in order: byte spans, the text each belongs to, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of length texts + 1

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def space_mask(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(s: Slice) -> Words:
    solid = ~space_mask(s.data)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    cuts = s.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(solid))]
    begins[cuts] = solid[cuts]  # a text's first byte never continues the text before
    ends[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, s.offsets)
    doc = np.repeat(np.arange(len(s)), np.diff(first))
    return Words(start, end, doc, first)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of every word's bytes, the same wherever the word stands."""
    if not len(w):
        return np.zeros(0, np.uint64)
    up = powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    down = powers(_BASE_INV, len(data))
    return mix((total[w.end] - total[w.start]) * down[w.start])


def grams(hashes: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every n consecutive words, by place of the first; len(hashes) - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(base)
        out += hashes[k : k + m]
    return mix(out)


def inside(w: Words, n: int) -> np.ndarray:
    """Places at which n consecutive words of one text begin."""
    if len(w) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.doc[: len(w) - n + 1] == w.doc[n - 1 :])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)`` for all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts)[keep], np.asarray(lengths)[keep]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many code points each span of UTF-8 bytes between neighbouring offsets holds."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.diff(lead[offsets])
