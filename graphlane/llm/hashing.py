"""Vectorised polynomial hashes modulo 2**64 over bytes and words."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of h over all bits of the result; different values stay different."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j : j + n]
    return mix(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, from its bytes and length."""
    if not words:
        return np.zeros(0, np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lens) - lens
    place = np.arange(len(raw)) - np.repeat(starts, lens)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(CODES[raw] * powers(int(lens.max()) + 1)[place], dtype=np.uint64)])
    return mix(sums[starts + lens] - sums[starts] + lens.astype(np.uint64))
