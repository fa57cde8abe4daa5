"""Hashed character n-grams of words, for whole batches of texts at once."""

from __future__ import annotations

import sys

import numpy as np

from .vector import U64

_tables: dict[str, np.ndarray] = {}


def char_table(kind: str) -> np.ndarray:
    """Whether each code point is a letter (``alpha``) or a letter or digit (``alnum``)."""
    if kind not in _tables:
        test = str.isalpha if kind == "alpha" else str.isalnum
        _tables[kind] = np.fromiter((test(chr(c)) for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables[kind]


def code_stream(texts: list[str | None], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, 0 where no word is, and each text's n + 1 offsets; a 0 stands on both sides of each text."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join([f"\0{t}\0" for t in low]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])]).astype(np.int64)
    return np.where(char_table(kind)[codes], codes, 0), offsets


def buckets(codes: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each place, and whether it is one of a word: letters, with a word's edge at either end at most."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x = codes.astype(U64)
    h = np.full(m, n, U64)
    for j in range(n):
        h = (h + x[j : m + j]) * U64(0x9E3779B97F4A7C15 + 2 * n)
        h ^= h >> U64(29)
    inside = codes > 0
    if n <= 2:
        valid = inside[:m] | inside[n - 1 :]
    else:
        valid = inside[1 : m + 1].copy()
        for j in range(2, n - 1):
            valid &= inside[j : m + j]
    return ((h * U64(0xD1342543DE82EF95)) >> U64(64 - bits)).astype(np.int64), valid


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, 0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
