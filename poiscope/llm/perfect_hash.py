"""Minimal perfect hash of 128-bit keys held as two columns of 64-bit numbers, in numpy.

Level by level, every key left over sets a bit of an array twice as long as there are keys; keys
alone on their bit are placed, the others go to the next level. A key's slot is the rank of its bit.
"""

from __future__ import annotations

import numpy as np

# Multipliers of a 64-bit finaliser.
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
LEVELS = 64


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b + _STEP * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27)) ^ b) * _M2
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[list[int], bytes]:
    """(sizes of the levels, their bits) for distinct keys."""
    sizes, parts, left = [], [], np.arange(len(a))
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, 2 * len(left) + (-2 * len(left)) % 8)
        at = _position(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(np.packbits(alone).tobytes())
        left = left[~alone[at]]
    return sizes, b"".join(parts)


class PerfectHash:
    """Slots 0..n-1 of the n keys it was built from; -1 or an arbitrary slot for any other key."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.levels, start, before = [], 0, 0
        for size in sizes:
            level = np.unpackbits(np.frombuffer(bits, np.uint8, size // 8, start)).astype(bool)
            rank = before + np.cumsum(level) - 1
            self.levels.append((size, level, rank))
            start, before = start + size // 8, before + int(level.sum())

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for n, (size, level, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = _position(a[left], b[left], n, size)
            hit = level[at]
            slots[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return slots
