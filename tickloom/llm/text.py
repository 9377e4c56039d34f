"""Vectorised word and hash helpers over Arrow string arrays.

Everything works on the UTF-8 bytes of a slice of documents at once: bytes are never turned into Python strings. A word is a maximal run
of bytes outside ``0x20`` and ``0x09-0x0D``; ``A-Z`` are lowered, other bytes stay. Word hashes are 64 bit and depend on the bytes alone, so
they are equal on every worker and in every run.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLICE_BYTES = 1 << 19
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []
droppers: list[Callable[[], None]] = [_powers.clear]  # what empties the things that modules keep in a worker between tasks


def release() -> None:
    """Give back what earlier tasks left in this worker; for tasks that need much memory themselves."""
    for drop in droppers:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and ``BASE ** -i`` modulo 2**64 for i in 0..n-1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls become empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an array into runs of rows of about ``limit`` bytes: first row, end row, their bytes, their offsets from 0.

    A row is never cut: a longer one is a slice of its own.
    """
    if not len(column):
        return
    data, offsets = string_buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of a slice: ``start``/``end`` byte positions in it, 64-bit ``hash``, and ``first[d]:first[d + 1]`` the words of row d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows ``data[offsets[d]:offsets[d + 1]]`` and their hashes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a row ends every word
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def shingles(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive words; a shorter, non-empty sequence counts as one."""
    n = len(hashed)
    if n == 0:
        return hashed
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out *= BASE
        out += hashed[i:n - width + 1 + i]
    return mix(out)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as one plain array."""
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
