"""Vectorised text primitives: packed bytes, units and span hashes.

Texts arrive as Arrow string columns.  They are handled as one byte array with
document offsets, so that no Python code runs per word or per byte.  Span hashes
are differences of prefix polynomials modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a longer document is one step.
STEP_BYTES = 1 << 20

_U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(n, base & (1 << 64) - 1, _U)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


class Spans:
    """Hashes of any span of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        _grow(n + 1)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(symbols * _powers[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * _inverses[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k symbols from each position on, as far as there are k."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, _U)
        return mix((self.prefix[k:] - self.prefix[:-k]) * _inverses[: n - k + 1])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _LOWER[data]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_seen = 0


def _release(size: int) -> None:
    """Gives memory that numpy and Arrow no longer use back now and then; workers outlast operators."""
    global _seen
    _seen += size
    if _seen >= 32 * STEP_BYTES:
        _seen = 0
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their bytes and offsets, of about ``most`` bytes each."""
    data, offsets = packed(batch.column(column))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(last, first + 1), first + 50_000)
        yield slice(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    _release(len(data))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word."""
    return _units(~_SPACE[data], offsets)


def _units(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[offsets < n]
    opens[edges] = inside[edges]
    edges = offsets[offsets > 0] - 1
    closes[edges] = inside[edges]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, empty ones too, and each document's first line.

    A document without text has one empty line.
    """
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    before = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    ends = np.empty_like(starts)
    last = np.zeros(len(starts), bool)
    last[before[1:] - 1] = True
    ends[last] = offsets[1:]
    ends[~last] = feeds
    return starts, ends, before
