"""Vectorised words and shingles over Arrow strings: what the sketching operators share.

A chunk of documents is one byte buffer. Words, their 64-bit hashes and the hashes of word windows are
found for the whole chunk with numpy, so the cost per document is small whatever its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}
#: Texts are taken in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 19

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between terms, which are runs of ASCII digits, lower-case ASCII letters and all that isn't ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def thrifty(f: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """f over the batches of a task, which gives free memory back to the system when the task ends: workers live on from task to task."""

    @wraps(f)
    def run(batches: Iterable) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only the GNU library has it
                pass

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... mod 2**64, n of them at least."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 1), base, U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if len(have) <= 4 * CHUNK:
            _pow[base] = have
    return have


def chunks(col: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of runs of rows; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, len(col))
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(buf: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each document's first word, one more entry at the end) of maximal runs of bytes that aren't blank."""
    full = np.zeros(len(buf) + 2, bool)
    full[1:-1] = ~blank[buf]
    edge = np.zeros(len(buf) + 1, bool)  # a text starts here
    edge[at] = True
    starts = np.flatnonzero(full[1:] & (~full[:-1] | edge))
    ends = np.flatnonzero(full[:-1] & (~full[1:] | edge))
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of the words, from prefix sums of a polynomial over the values of bytes."""
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(values[buf] * powers(_BASE, len(buf))[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_UNBASE, len(buf) + 1)[starts])


def shingles(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-word windows, first index per document). A document of 1 to k-1 words has one: all its words."""
    per = np.diff(first)
    n = np.where(per >= k, per - k + 1, (per > 0).astype(per.dtype))
    ptr = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(ptr[-1], U)
    long = per >= k
    if long.any():
        m = len(w) - k + 1
        h = np.zeros(m, U)
        for j in range(k):
            h = (h ^ w[j : j + m]) * U(_BASE + 2 * j)
            h ^= h >> U(29)
        valid = np.zeros(len(w) + 1, np.int32)
        np.add.at(valid, first[:-1][long], 1)
        np.add.at(valid, first[1:][long] - k + 1, -1)
        valid = np.cumsum(valid)[:m] > 0
        takes = np.zeros(ptr[-1] + 1, np.int32)
        np.add.at(takes, ptr[:-1][long], 1)
        np.add.at(takes, ptr[1:][long], -1)
        out[np.cumsum(takes)[:-1] > 0] = mix(h[valid] + U(k))
    for size in range(1, k):
        d = np.flatnonzero(per == size)
        if len(d):
            h = np.zeros(len(d), U)
            for j in range(size):
                h = (h ^ w[first[d] + j]) * U(_BASE + 2 * j)
                h ^= h >> U(29)
            out[ptr[d]] = mix(h + U(size))
    return out, ptr


def distinct(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted, without repeats."""
    h = h.copy()
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    if len(h) > 1:
        keep[1:] = h[1:] != h[:-1]
        keep[ptr[:-1][ptr[:-1] < len(h)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], total[ptr]


def shingle_sets(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles (A-Z lower-cased, words without white space), and where each document's begin."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, at)
    return distinct(*shingles(word_hashes(buf, starts, ends), first, k))


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i+1]], modulo 2**64."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[ptr[1:]] - total[ptr[:-1]]
