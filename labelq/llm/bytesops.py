"""Vectorised passes over the UTF-8 bytes of Arrow string columns.

The functions read a column's byte buffer in pieces of about ``PIECE`` bytes, so the temporary arrays
stay small however long a text is; texts are always processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def byte_values(keep: str = "words", fold: bool = True, seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte, 0 for separators; A-Z share the values of a-z when ``fold``.

    ``words``: separators are space and U+0009-U+000D. ``letters``: separators are all ASCII but letters."""
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    if keep == "words":
        values[[32, 9, 10, 11, 12, 13]] = 0
    else:
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = letters[128:] = True
        values[~letters] = 0
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    with np.errstate(over="ignore"):
        while done < n:
            m = min(done, n - done)
            out[done:done + m] = out[:m] * np.uint64(pow(base, done, 1 << 64))
            done += m
    return out


class WordHasher:
    """64-bit hashes of the words of a column, in order; equal words have equal hashes."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE + 1)
            self.up, self.down = _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)

    def _spans(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges that cut no word: whole texts together, long texts at separators."""
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end:
            hi = min(lo + PIECE, end)
            if hi < end:
                at = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
                if at > lo:
                    hi = at
                else:
                    stop, size = int(offsets[np.searchsorted(offsets, lo, "right")]), PIECE
                    while True:
                        hi = min(lo + size, stop)
                        gaps = np.flatnonzero(self.values[raw[lo:hi]] == 0)
                        if hi == stop or len(gaps):
                            hi = stop if hi == stop else lo + int(gaps[-1]) + 1
                            break
                        size *= 2
            yield lo, hi
            lo = hi

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, first word of each text and one past the last)."""
        found, starts_at, bases = [], [], []
        total = 0
        with np.errstate(over="ignore"):
            for lo, hi in self._spans(raw, offsets):
                v = self.values[raw[lo:hi]]
                inside = v != 0
                before = np.empty_like(inside)
                before[0] = False
                before[1:] = inside[:-1]
                a, b = np.searchsorted(offsets, lo), np.searchsorted(offsets, hi)
                before[offsets[a:b] - lo] = False
                starts = np.flatnonzero(inside & ~before)
                if len(starts):
                    self._grow(hi - lo)
                    v *= self.up[:hi - lo]
                    found.append(mix(np.add.reduceat(v, starts) * self.down[starts]))
                    starts_at.append(starts + lo)
                    total += len(starts)
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        where = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
        return hashes, np.searchsorted(where, offsets)


def slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, size):
        yield lo, min(lo + size, n)
