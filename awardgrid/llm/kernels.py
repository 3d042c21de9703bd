"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these bytes inside
a longer character, so words of bytes and words of characters are the same. Texts are handled in
slices of about ``SLICE`` bytes, whatever the size of the Arrow batch, so memory is bounded by the
longest single text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOW52 = np.uint64((1 << 52) - 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ODD = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_libc = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 2 * SLICE)
        for k, base in enumerate((_BASE, _BASE_INV)):
            x = np.full(m, np.uint64(base))
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) with at most 4,096 rows each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + 4096, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte bounds, 64-bit hashes, and for each text its first word's index."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offs: np.ndarray, lower: bool, blank: np.ndarray = BLANK) -> Words:
    """lower: A-Z and a-z count as equal. blank: the bytes that words don't hold."""
    n = len(data)
    solid = ~blank[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = solid[cut]
    end[cut - 1] = solid[cut - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    h = mix((total[stop] - total[start]) * down[start])
    return Words(start, stop, h, np.searchsorted(start, offs))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text, and the index of each one's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:n] * _ODD[0]
    for j in range(1, k):
        h += w.hash[j : n + j] * _ODD[j]
    doc = w.doc
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (52-bit hashes, ascending within a text) and each text's bounds.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    h, at = windows(w, k)
    count = np.diff(w.first)
    doc = w.doc
    key = (doc[at].astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))
    if (short := np.flatnonzero((count > 0) & (count < k))).size:
        own = []
        for d in short:
            x = np.full(1, count[d], np.uint64)
            for v in w.hash[w.first[d] : w.first[d + 1]]:
                x = mix(x * _ODD[40] + v)
            own.append((np.uint64(d) << np.uint64(52)) | (x[0] >> np.uint64(12)))
        key = np.concatenate([key, np.array(own, np.uint64)])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(len(count) + 1, dtype=np.uint64) << np.uint64(52))
    return key & LOW52, bounds
