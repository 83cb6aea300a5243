"""Vectorised word and shingle hashing over Arrow string columns.

Words are hashed with a polynomial modulo 2**64 over randomised bytes and a final avalanche, so that a whole batch is
hashed by a few numpy passes, without a Python string per word. Equal words always hash alike; different ones collide
with a probability near 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (on lower-cased text).
ALNUM = np.ones(256, bool)
ALNUM[[*range(0, 48), *range(58, 97), *range(123, 128)]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(GROUP_BYTES, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = tuple(out)
    return _powers[size]


def release() -> None:
    """Give free memory back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + GROUP_BYTES, "right")))
        part = data[base : ends[j - 1]]
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: each word's hash, row, first byte and end."""
    if not len(data):
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z
    data = LOWER[data]
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return hash_spans(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def combine(h: np.ndarray, at: list[int] | range, salt: int = 0) -> np.ndarray:
    """Hash of the words at positions i + at[0], i + at[1], ... for every i where they exist."""
    n = len(h) - max(at)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(salt * 2 + 1), np.uint64)
    for k, a in enumerate(at):
        out += h[a : a + n] * _COEF[k]
    return mix(out)


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k`` words of each row, and their rows, by row and hash. Fewer words than ``k``: all as one."""
    hs, hd = combine(h, range(k)), row[: max(0, len(h) - k + 1)]
    if len(hs):
        whole = hd == row[k - 1 :]
        hs, hd = hs[whole], hd[whole]
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(row, short)
        own = [combine(h[f : f + n], range(n), salt=n)[0] for f, n in zip(first, count[short])]
        hs, hd = np.concatenate([hs, np.array(own, np.uint64)]), np.concatenate([hd, short])
    order = np.lexsort((hs, hd))
    hs, hd = hs[order], hd[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (hs[1:] != hs[:-1]) | (hd[1:] != hd[:-1])
    return hs[keep], hd[keep]
