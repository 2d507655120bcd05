"""Minimal perfect hashing of distinct 32-bit keys.

A level hashes the keys left into a bitmap of twice as many bits; keys that are alone on
their bit stay there, the others go on to the next level. A key's number is the count of bits
set before its own, so n keys have the numbers 0 to n - 1. A key that was not hashed gets some
number too: whoever must tell compares the key stored there.
"""

from __future__ import annotations

import numpy as np

BITS_PER_KEY = 2


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self._before = []  # bits set before each byte, over all levels
        total = 0
        for bits in self.levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self._before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Hash of distinct keys."""
        levels, rest = [], keys
        while len(rest):
            size = -(-BITS_PER_KEY * len(rest) // 8) * 8
            at = (_mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            held = np.bincount(at, minlength=size)
            levels.append(np.packbits(held == 1, bitorder="little").tobytes())
            rest = rest[held[at] > 1]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for a key that meets no bit."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self._before, strict=True)):
            if not len(left):
                break
            at = (_mixed(keys[left], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            on = (byte >> bit) & 1 == 1
            lower = byte & ((np.uint8(1) << bit) - np.uint8(1))
            out[left[on]] = (before[at >> 3] + np.bitwise_count(lower))[on]
            left = left[~on]
        return out


class CountTable:
    """Counts of keys in vectors indexed by their hash; stored keys are compared."""

    def __init__(self, levels: list[bytes], keys: np.ndarray, *vectors: np.ndarray):
        self.hash, self.keys, self.vectors = PerfectHash(levels), keys, vectors

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each vector the keys' values; 0 for keys the table does not hold."""
        at = np.maximum(self.hash.numbers(keys), 0)
        if not self.hash.size:
            return tuple(np.zeros(len(keys), v.dtype) for v in self.vectors)
        known = self.keys[at] == keys
        return tuple(np.where(known, v[at], 0) for v in self.vectors)
