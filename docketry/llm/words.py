"""Vectorised word and shingle hashing over Arrow text batches.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Every hash is a
fixed function of the bytes, so a task that is run again gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
# Bytes hashed at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_position_keys = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int = 1) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _positions(n: int) -> np.ndarray:
    global _position_keys
    if len(_position_keys) < n:
        _position_keys = keys(max(2 * n, 1024)) | np.uint64(1)
    return _position_keys


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, first word of every row (one more entry at the end), start byte of every word."""
    rows = len(offsets) - 1
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads[inside[heads]]] = True
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), starts
    at = np.arange(len(data), dtype=np.int64)
    word = np.cumsum(begin) - 1
    place = at - starts[np.maximum(word, 0)]
    table = _positions(int(place.max()) + 1)
    value = (LOWER[data] + np.uint64(1)) * table[place]
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, offsets), starts


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row. Fewer than ``k`` words: the whole sequence as one."""
    factors = keys(k + 1, 7) | np.uint64(1)
    total = max(len(hashes) - k + 1, 0)
    joined = np.zeros(total, np.uint64)
    for j in range(k):
        joined += hashes[j:j + total] * factors[j]
    joined = mix(joined)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= k:
            yield np.unique(joined[a:b - k + 1])
        elif n:
            yield mix((hashes[a:b] * factors[:n]).sum(keepdims=True) + factors[k:] * np.full(1, n, np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def text_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Shingle set of every text of an Arrow column, slice by slice."""
    data, offsets = text_buffers(column)
    for first, last in slices(offsets):
        part = offsets[first:last + 1]
        hashes, words, _ = word_hashes(data[part[0]:part[-1]], part - part[0])
        yield from shingle_sets(hashes, words, k)


class Permutations:
    """Universal hash permutations ``a * x + b mod 2^32`` (``a`` odd) of 32-bit shingle values."""

    def __init__(self, count: int, seed: int = 11):
        self.a = (keys(count, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (keys(count, seed + 1) >> np.uint64(32)).astype(np.uint32)

    def minima(self, shingles: np.ndarray, block: int = 1 << 13) -> np.ndarray:
        """Minimum of every permutation; all ones for the empty set."""
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), block):
            values = self.a[:, None] * x[None, at:at + block]
            values += self.b[:, None]
            np.minimum(low, values.min(axis=1), out=low)
        return low


def jaccard_counts(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct sets."""
    if not len(left) or not len(right):
        return 0, len(left) + len(right)
    at = np.searchsorted(right, left)
    both = int((right[np.minimum(at, len(right) - 1)] == left).sum())
    return both, len(left) + len(right) - both


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band number mixed in."""
    parts = low[:bands * rows].reshape(bands, rows).astype(np.uint64)
    factors = keys(rows, 23) | np.uint64(1)
    return mix((mix(parts + np.uint64(1)) * factors).sum(axis=1, dtype=np.uint64) + keys(bands, 29))
