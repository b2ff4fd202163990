"""Sets of word shingles as 64-bit hashes, for whole Arrow columns at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rarebucket.llm.common import mixed, utf8

#: A-Z become a-z; other bytes stay, so no letter outside ASCII changes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts on end, and the row of each word. A word's hash is of its lower-cased bytes."""
    body, offsets = utf8(column)
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[body]
    inside = ~SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # where a text starts or ends
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[low]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, n)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)), np.searchsorted(offsets[1:], starts, "right")


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles; fewer words than ``size`` are one shingle, no word is none."""
    hashes, row = words(column)
    bounds = np.searchsorted(row, np.arange(len(column) + 1))
    last = max(0, len(hashes) - size + 1)
    joined = np.zeros(last, np.uint64)
    for k in range(size):
        joined = joined * np.uint64(0xC6A4A7935BD1E995) + hashes[k : k + last]
    joined = mixed(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * np.uint64(0x2127599BF4325C37) + h
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
