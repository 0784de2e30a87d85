"""Words of Arrow text columns as numpy arrays, block by block.

A block is a run of rows whose texts have about ``BLOCK_BYTES`` bytes together; a longer text is cut at white space
into several blocks, so memory is bounded by the block and not by the longest text. White space is the six ASCII
characters space and ``\\t\\n\\v\\f\\r``. Word hashes are 64-bit polynomials of the word's bytes, mixed at the end.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Everything but ASCII letters, digits and the bytes of other characters.
PUNCTUATION = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Polynomial:
    """Hashes of spans of a sequence from one running sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.up) <= n:
            self.up, self.down = powers(n + n // 4 + 2), powers(n + n // 4 + 2, _INVERSE)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hash of ``values[s:e]`` for each span; equal spans have equal hashes wherever they stand."""
        self.reserve(len(values))
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=total[1:])
        length = (ends - starts).astype(np.uint64)
        return mix((total[ends] - total[starts]) * self.down[starts] + length)


@dataclass
class Block:
    """Words of some rows: ``row`` (in the batch), ``start`` and ``end`` (bytes in ``data``), both ascending."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset or not len(column):
        column = pa.concat_arrays([pa.array([], pa.large_string()), column])
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, size: int, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    start, total = 0, int(offsets[-1])
    while start < total:
        stop = min(start + size, total)
        if stop < total:
            ends = offsets[np.searchsorted(offsets, start, side="right") : np.searchsorted(offsets, stop, side="right")]
            if len(ends):
                stop = int(ends[-1])
            else:
                while stop < total and not gap[data[stop]]:
                    stop += 1
                stop = min(stop, int(offsets[np.searchsorted(offsets, start, side="right")]))
        yield start, stop
        start = stop


def words(
    column: pa.Array, lower: bool = False, size: int = BLOCK_BYTES, gap: np.ndarray = _WHITE
) -> Iterator[Block]:
    """The words of a column, in order, block by block; ``gap`` tells which bytes stand between words."""
    data, offsets = utf8(column)
    for start, stop in _cuts(data, offsets, size, gap):
        part = _LOWER[data[start:stop]] if lower else data[start:stop]
        inside = ~gap[part]
        first = np.zeros(len(part) + 1, dtype=bool)
        edges = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, side="right")] - start
        first[edges] = True
        first[0] = True
        before = np.empty(len(part) + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        after = np.append(inside, False)
        begin = np.flatnonzero(after & (first | ~before))
        end = np.flatnonzero(before & (first | ~after))
        row = np.searchsorted(offsets, begin + start, side="right") - 1
        yield Block(part, row, begin, end)


def per_row(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of ``values`` by row, as float64."""
    return np.bincount(row, weights=values, minlength=n_rows)


def map_batches(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], rows: int = 1024):
    """A function for ``mapInArrow`` that gives ``work`` at most ``rows`` rows at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from work(batch.slice(at, rows))
            del batch
        give_back()

    return run


def give_back() -> None:
    """Give freed memory back to the system at the end of a task: a worker lives on and waits for later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
