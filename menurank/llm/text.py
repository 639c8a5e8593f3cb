"""Vectorised word hashing of Arrow string columns, used inside Spark tasks.

A word is a maximal run of bytes other than space and \\t..\\r; A-Z are lowered,
other characters are left alone. A word's 64-bit hash is a polynomial over its
bytes, taken from prefix sums so that all words of a slice are hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 19

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        made = []
        for factor in (BASE, INVERSE):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of consecutive texts: `hashes` of all, and `first[i]:first[i + 1]` are those of text i."""

    hashes: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes each; a longer text is a range of its own."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end
        begin = end


def split(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """The words of the texts that `offsets` delimits in `data`: runs of bytes that `space` doesn't mark."""
    base = int(offsets[0])
    low = LOWER[data[base : int(offsets[-1])]]
    bounds = offsets - base
    n = len(low)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~space[low]
    begins, stops = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < n)]
    cut = cut[inside[cut] & inside[cut + 1]]
    begins[cut] = True
    stops[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, bounds)
    return Words(hashes, first, np.diff(first), starts, ends)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries (len - n + 1 of them)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:size] + np.uint64(n)
    for i in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + size])
    return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word runs and the bounds of the texts in them.

    A text of fewer than n words, but at least one, has its whole sequence as
    its only run; a text without words has none.
    """
    counts = np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(bounds[-1], dtype=np.uint64)
    runs = chain(words.hashes, n)
    full = words.counts >= n
    at = np.repeat(words.first[:-1][full] - bounds[:-1][full], counts[full])
    to = np.repeat(full, counts)
    out[to] = runs[np.flatnonzero(to) + at]
    for i in np.flatnonzero((words.counts > 0) & ~full):
        out[bounds[i]] = chain(words.hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0]
    return out, bounds
