"""Hashes of words and of stretches of words, for whole texts at a time."""

from __future__ import annotations

import numpy as np

BASE, STEP, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    h = (h ^ (h >> np.uint64(29))) * BASE
    return h ^ (h >> np.uint64(32))


class Powers:
    """The powers of an odd number and of its inverse modulo 2^64, kept for as many as were asked for."""

    def __init__(self, base: np.uint64):
        self._bases = base, np.uint64(pow(int(base), -1, 1 << 64))
        self._kept = [np.ones(1, np.uint64)] * 2

    def up_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._kept[0]) < n:
            for k, b in enumerate(self._bases):
                p = np.full(1 << (n - 1).bit_length(), b)
                p[0] = 1
                self._kept[k] = np.cumprod(p)
        return self._kept[0][:n], self._kept[1][:n]


_BYTES, _WORDS = Powers(BASE), Powers(STEP)


def word_hashes(t: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each run of bytes that are not space. The last byte must be one."""
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    power, back = _BYTES.up_to(len(t) + 1)
    sums = np.empty(len(t) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((t + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * back[first]), first, last


class Stretches:
    """Hashes of any stretch of a sequence of hashes."""

    def __init__(self, h: np.ndarray):
        power, self.back = _WORDS.up_to(len(h) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1])))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of [lo, hi)."""
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * BASE)
