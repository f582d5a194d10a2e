"""Texts as one flat byte array, and bucket identifiers over it, in numpy.

Everything works on a whole Arrow string column at once. A column of texts is
one buffer of bytes with document offsets; words, q-grams and windows are
integer positions in that buffer. Identifiers are 64-bit: a longer string is
named by mixing the names of two (overlapping) shorter strings that cover it.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: White space of the word contract: 0x20 and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240917)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
ODD = U(0x9E3779B97F4A7C15)
BASE = U(0xD6E8FEB86659FD93)


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits, in a fresh array."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of what is named a followed (or overlapped) by what is named b."""
    x = a * ODD
    x += b
    x ^= x >> U(32)
    x *= BASE
    x ^= x >> U(29)
    return x


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n+1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~WHITE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = ink[edge]
    last[edge - 1] = ink[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256) * 2, BASE))])
    return _powers


def word_names(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each word's bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s
    at = np.cumsum(size) - size
    local = np.arange(int(size.sum()), dtype=np.int64)
    local -= np.repeat(at, size)
    p = powers(int(size.max()) + 1)
    terms = BYTE_CODE[data[local + np.repeat(s, size)] ^ np.uint8(seed)] * p[local]
    return mix(np.add.reduceat(terms, at) + size.astype(np.uint64) * ODD)


def chains(names: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Names of runs of lengths[-1] items; each step of lengths at most doubles the one before (the first is 1)."""
    have, x = 1, names
    for n in lengths:
        by = n - have
        if len(x) <= by:
            return np.zeros(0, np.uint64)
        x = pair(x[: len(x) - by], x[by:])
        have = n
    return x


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each key whether the sorted table has it."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Mask of the n positions that lie in [start, start + length) for some start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def lengths_of(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many are True in each [off[i], off[i+1])."""
    c = np.concatenate([[0], np.cumsum(mask)])
    return c[off[1:]] - c[off[:-1]]


def release() -> None:
    """Gives freed memory back: workers live on between tasks, and what they keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
