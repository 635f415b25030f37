"""Words of whole Arrow batches as arrays: places, and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240501)
BYTE_KEYS = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    if base not in _powers or len(_powers[base]) < n:
        seq = np.full(max(n, 1 << 20), base, np.uint64)
        seq[0] = 1
        _powers[base] = np.multiply.accumulate(seq)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a batch: bytes, start and end of each word in them, its hash, first word of each text (and the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray
    offsets: np.ndarray


def words_of(column: pa.Array) -> Words:
    """Maximal runs of bytes other than space and 0x09 to 0x0D; none in null or empty texts."""
    column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if bounds else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~SEPARATOR[data]
    begins, stops = inside[:n].copy(), inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    stops &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * powers(BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)


def shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """Hashes of the runs of ``k`` words of each text; of all words where there are fewer, none where there is no word."""
    h = words.hashes
    salt = powers(INVERSE ^ 2, k + 1)
    run = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        run += h[j : j + len(run)] * salt[j + 1]
    run = mix(run)
    out = []
    for a, b in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(run[a : b - k + 1])
        else:
            out.append(mix((h[a:b] * salt[1 : b - a + 1]).sum(keepdims=True, dtype=np.uint64)) if b > a else h[:0])
    return out
