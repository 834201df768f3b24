"""Helpers of the vectorised text work inside tasks: chunks of rows, word spans and their hashes.

A chunk is a run of whole rows; a row longer than the chunk size is a chunk of its own, so nothing is ever cut.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters or bytes that one chunk holds at most (unless a single row is longer).
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C55)  # odd, so invertible modulo 2**64
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that returns to the system, when it ends, the memory it took: worker processes are used again."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns free memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of spans of a symbol array; equal symbol sequences have equal hashes wherever they stand."""

    def __init__(self) -> None:
        self._size, self._power, self._inverse = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n <= self._size:
            return
        n = max(n, CHUNK + 1)
        for name, base in (("_power", _P), ("_inverse", _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        self._size = n

    def hashes(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, np.uint64)
        weighted = symbols.astype(np.uint64)
        weighted += np.uint64(1)
        weighted *= self._power[: len(symbols)]
        np.cumsum(weighted, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within rows: starts, ends, and for each row the range of its runs (n rows + 1).

    ``offsets`` are the row bounds in ``inside``; a run never crosses them.
    """
    if not len(inside):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[full] = inside[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def fold(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` consecutive hashes (len - words + 1 of them)."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, words):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
        out = mix(out)
    return out


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (NULL as empty) and the bounds of its rows, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), bounds


def row_chunks(bounds: np.ndarray, size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of rows that hold ``size`` symbols and ``rows`` rows at most, or a single row."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(max(last, first + 1), n, first + rows)
        yield first, last
        first = last


class Codes:
    """Code points of a chunk of texts and their classes; a code point is classified when it is first seen."""

    LETTER, WORD, UPPER, DIGIT, SPACE, SEEN = 1, 2, 4, 8, 16, 128

    def __init__(self) -> None:
        self.classes = np.zeros(0x110000, np.uint8)

    def flags(self, symbols: np.ndarray) -> np.ndarray:
        """The classes of each symbol as bits."""
        out = self.classes[symbols]
        fresh = out == 0
        if fresh.any():
            for point in np.unique(symbols[fresh]).tolist():
                c = chr(point)
                self.classes[point] = (
                    self.SEEN | self.LETTER * c.isalpha() | self.WORD * (c.isalnum() or c == "_") | self.UPPER * c.isupper()
                    | self.DIGIT * c.isdigit() | self.SPACE * c.isspace()
                )
            out = self.classes[symbols]
        return out

    def letter(self, symbols: np.ndarray) -> np.ndarray:
        return (self.flags(symbols) & self.LETTER) > 0

    def word(self, symbols: np.ndarray) -> np.ndarray:
        return (self.flags(symbols) & self.WORD) > 0

    @staticmethod
    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One array for all texts and the bounds of each."""
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def text_chunks(texts: list[str], size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return row_chunks(bounds, size, rows)


def strings(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()
