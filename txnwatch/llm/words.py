"""Word hashes of many texts at once, in numpy: for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_229)
BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def give_back() -> None:
    """Free memory goes back to the system: a worker keeps it else, beside the full heap of its JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text.

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
    return. The sum of coded bytes times powers of an odd base is a prefix sum, so all words are
    hashed without a loop.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = IS_GAP[buffer]
    before = np.empty(len(gap), bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(gap & ~before)
    codes = BYTE_CODE[LOWER[buffer]] if lower else BYTE_CODE[buffer]
    codes *= _power("base", _BASE, len(buffer))
    sums = np.cumsum(codes, dtype=np.uint64)
    sums -= codes  # exclusive
    hashes = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, len(buffer))[starts]
    text_ends = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return mixed(hashes + (ends - starts).astype(np.uint64)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, in order; fewer words give one short shingle.

    Returns the hashes and the number of shingles of each text.
    """
    offsets = np.concatenate(([0], np.cumsum(counts)))
    odd = np.random.default_rng(k).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(hashes)
    rolled = np.zeros(max(n, 1), np.uint64)
    for i in range(k):
        rolled[: max(n - i, 0)] += hashes[i:] * odd[i]
    rolled = mixed(rolled)
    each = np.maximum(counts - k + 1, 0)
    keep = np.ones(n, bool)
    for i in range(1, k):  # the last k-1 words of a text start no shingle
        at = offsets[1:] - i
        keep[at[at >= offsets[:-1]]] = False
    full = rolled[:n][keep]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return full, each
    values = []
    for t in short:
        part = hashes[offsets[t] : offsets[t + 1]]
        values.append(np.sum(part * odd[: len(part)], dtype=np.uint64) + np.uint64(len(part) ** 3))
    places = np.concatenate(([0], np.cumsum(each)))[short]
    each = each.copy()
    each[short] = 1
    return np.insert(full, places, mixed(np.array(values, np.uint64))), each


def batches(texts: list[bytes], most: int):
    """Slices (from, to) of consecutive texts of at most ``most`` bytes; a longer text comes alone."""
    return slices(map(len, texts), most)


def slices(lengths: Iterable[int], most: int):
    """Slices (from, to) of consecutive lengths that add up to at most ``most``; a greater one comes alone."""
    start = end = total = 0
    for i, length in enumerate(lengths):
        if i > start and total + length > most:
            yield start, i
            start, total = i, 0
        total += length
        end = i + 1
    if end > start:
        yield start, end
