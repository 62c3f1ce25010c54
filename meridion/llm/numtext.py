"""Vectorised text primitives on Arrow buffers: bytes, words, rolling hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\r\x0b\x0c"
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
#: Bytes hashed at a time; the arrays of a slab stay in a core's cache.
SLAB = 1 << 17


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def stretches(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes of one text that end at white space, or after it where a word is longer."""
    i = 0
    while i < len(data):
        j = i + limit
        while j < len(data) and not len(found := np.flatnonzero(_IS_SEPARATOR[data[j : j + limit]])):
            j += limit
        j = len(data) if j >= len(data) else j + int(found[0])
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) <= n:
        size = max(n + 1, 1 << 16)
        base = np.full(size, _ODD)
        base[0] = 1
        inverse = np.full(size, _INVERSE)
        inverse[0] = 1
        _up, _down = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _up, _down


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span; equal contents give equal hashes."""
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words, and the index of the first word of each row (one more at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SEPARATOR[data]
    first = np.empty(len(data), bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], starts, ends)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each run of `width` values (the first of equal ones)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: n], m[width - size : width - size + n])
    return (m[:n] & low).astype(np.int64)
