"""Vectorised word and window hashing over Arrow text columns.

All functions work on whole texts. A *word* is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; hashes are 64 bits wide, so a false match between two
different words or windows among n has a chance of about ``n**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and base**-(0..n-1), modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of rows of about ``limit`` bytes (one row at least).

    Yields (first row, end row, bytes, offsets), a null text being empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(column: pa.Array, most: int = 1 << 20):
    """(first row, end row, values) of a text or binary column, about ``most`` bytes and one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    end, at = np.cumsum(size), 0
    while at < len(size):
        done = int(end[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + most, "right")))
        yield at, to, column.slice(at, to - at).to_pylist()
        at = to


class Words:
    """The words of a run of rows: their byte spans, 64-bit hashes and, by row, where they begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        rows = len(offsets) - 1
        if not len(data):
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(rows + 1, np.int64)
            self.sums = np.zeros(1, np.uint64)
            return
        if lower:
            data = _LOWER[data]
        inside = ~SPACE[data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        up, down = powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up, out=sums[1:])
        self.sums = sums
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of every window of n words within one row, and each one's first word."""
        k = len(self.hash)
        if k < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = powers(k + 1)
        sums = np.zeros(k + 1, np.uint64)
        np.cumsum(self.hash * up[:k], out=sums[1:])
        at = np.arange(k - n + 1)
        row = self.rows()
        at = at[row[: k - n + 1] == row[n - 1 :]]
        return mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)), at


def covered(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` words lie in a window of n words that begins at one of ``first``."""
    step = np.zeros(count + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + n, count), -1)
    return np.cumsum(step[:-1]) > 0
