"""Texts as flat byte arrays: slices of bounded size, word bounds and word hashes without per-word Python.

A text column of an Arrow batch already is one UTF-8 buffer with row offsets. Everything here works on that buffer:
a word is a run of bytes of one class, and its 64-bit hash comes from running sums, so a batch costs a few array passes
whatever its words are. A single text is never cut; it is the smallest slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in runs of rows of at most ``limit`` text bytes, or of one row."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(spans: list[tuple[int, int]], inside: bool) -> np.ndarray:
    """256 flags: the bytes in the spans (ends included) are word bytes, or all others are."""
    flags = np.full(256, not inside)
    for low, high in spans:
        flags[low : high + 1] = inside
    return flags


#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)], True)
#: Letters and every byte of a character beyond ASCII.
ALPHA = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)], True)
#: Everything but ASCII white space.
SOLID = byte_class([(0x09, 0x0D), (0x20, 0x20)], False)
#: Everything but the line feed.
LINE = byte_class([(0x0A, 0x0A)], False)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of several texts: byte bounds, 64-bit hashes, and for each text the range of its words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def raw(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.ends[at]].tobytes()


def running_sums(terms: np.ndarray) -> np.ndarray:
    """Sums from which ``hashes_of`` takes the hash of any span of the terms."""
    sums = np.zeros(len(terms) + 1, np.uint64)
    if len(terms):
        np.cumsum(terms * _power(_BASE, "up", len(terms)), out=sums[1:])
    return sums


def hashes_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, "down", len(sums))[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes."""
    return hashes_of(running_sums(BYTE_CODE[data]), starts, ends)


def words(column: pa.Array, is_word: np.ndarray, lower: bool) -> Words:
    """Maximal runs of word bytes inside each row, hashed; with ``lower``, A-Z count as a-z."""
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return Words(data, offsets, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the first word of each run."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = mix(total + hashes[k : n - width + 1 + k] + np.uint64(k + 1))
    left = np.repeat(bounds[1:], np.diff(bounds))[: n - width + 1] - np.arange(n - width + 1)
    first = np.flatnonzero(left >= width)
    return total[first], first


class Memo:
    """Results by 64-bit key in sorted arrays, filled as keys come up; started anew beyond ``most`` keys.

    It only saves repeated work: what it returns does not depend on what it holds.
    """

    def __init__(self, width: int, dtype, most: int = 1 << 20) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, width), dtype)
        self.most = most

    def get(self, keys: np.ndarray, compute) -> np.ndarray:
        """Values of sorted distinct keys; ``compute(positions)`` gives those of the positions not held yet."""
        if not len(keys):
            return self.values[:0]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.empty((len(keys), self.values.shape[1]), self.values.dtype)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = compute(new)
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = keys[new], out[new]
            else:
                self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], out[new], axis=0)
        return out
