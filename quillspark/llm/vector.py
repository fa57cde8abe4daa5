"""Whole texts as one byte buffer: words, their 64-bit hashes and shingles by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: Bytes of text worked on at once; hashing takes about 40 times as much memory.
SLICE_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z have been lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def doc_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 4 * SLICE_BYTES:  # an enormous text: not kept
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, and the index of its document; runs end with their document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mask = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | np.append(first[1:-1], True))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and the documents' n + 1 offsets into them."""
    data = LOWER[data] if lower else data
    starts, ends, doc = words(data, offsets, is_word)
    return span_hash(data, starts, ends), np.searchsorted(doc, np.arange(len(offsets)), "left")


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document its distinct shingles of ``k`` words, sorted; of one with fewer words, but not none, the whole as one."""
    n = len(hashes)
    h = np.zeros(max(0, n - k + 1), U64)
    for i in range(k):
        h = mix(h * U64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]) if len(h) else h
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        else:
            g = np.full(min(1, b - a), b - a, U64)
            for x in hashes[a:b]:
                g = mix(g * U64(0x9E3779B97F4A7C15) + x)
            out.append(g)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges start .. start + length, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.asarray(starts, np.int64), lengths) + np.arange(total) - at
