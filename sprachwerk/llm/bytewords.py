"""Words of many texts at once, as numpy arrays over the bytes that Arrow hands over.

A table of 256 classes cuts a buffer into runs; a polynomial hash modulo 2**64, taken from one running
sum, names each run; an open-addressing table turns names into small numbers. Work and memory are in
proportion to the bytes at hand: `pieces` deals out about one MB at a time, and a longer text is cut
after bytes of a class that its caller names, so nothing that the caller counts is ever cut in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
            _INV = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each data[start:end]; never zero."""
    n = len(data)
    _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _INV[starts]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return np.where(h == 0, np.uint64(1), h)


class Numbers:
    """Maps 64-bit names to int32 numbers; lookups and insertions are vectorised."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def get(self, names: np.ndarray) -> np.ndarray:
        """The number of each name, -1 where unknown."""
        mask = (1 << self.bits) - 1
        slot = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == names, self.values[slot], -1)
        open_ = np.flatnonzero((found != names) & (found != 0))
        while len(open_):
            slot_ = (slot[open_] + 1) & mask
            slot[open_] = slot_
            found = self.keys[slot_]
            hit = found == names[open_]
            out[open_[hit]] = self.values[slot_[hit]]
            open_ = open_[~hit & (found != 0)]
        return out

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        """New and distinct names."""
        if (self.n + len(names)) * 2 > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            bits = self.bits
            while (self.n + len(names)) * 3 > 1 << bits:
                bits += 1
            self.clear(bits)
            self._put(k, v)
        self._put(names, values)

    def _put(self, names: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(names))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = names[won]
            self.values[slot[won]] = values[won]
            done = np.zeros(len(names), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & mask
        self.n += len(names)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column of texts as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def pieces(column: pa.Array, most: int = 1 << 20, cut: np.ndarray | None = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row starts and the end) of rows of about `most` bytes together.

    A row much longer than that comes alone, over and over, in parts that end with a byte of the class
    `cut`; without such a byte a part goes on to the next, and without a class a row is never cut.
    """
    column = binary(column)
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, n)
        if cut is not None and end == row + 1 and at[end] - at[row] > 4 * most:
            a, b = int(at[row]), int(at[end])
            while a < b:
                c = min(a + most, b)
                while c < b and not cut[data[c - 1]]:
                    look = np.flatnonzero(cut[data[c : min(c + 65536, b)]])
                    c = min(c + (int(look[0]) + 1 if len(look) else 65536), b)
                yield row, data[a:c], np.array([0, c - a])
                a = c
        else:
            yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes; a run ends where a row ends."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = keep[:-1]
    edges = starts[:-1]
    before[edges[edges < n]] = False
    first = np.flatnonzero(keep & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = keep[1:]
    last = starts[1:] - 1
    after[last[last >= 0]] = False
    return first, np.flatnonzero(keep & ~after) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, … for each pair, side by side."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
