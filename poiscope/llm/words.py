"""Words and shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

REMEMBERED = 300_000
# fixed values: the primes of xxh64
_PRIMES = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier


class WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


KEPT: list[Callable[[], None]] = []


def tidied(results: Iterator, keeps: Callable[[], None] | None = None) -> Iterator:
    """The results of a task; at its end the Python worker drops the hashes of words and gives free memory back.

    Workers live on between tasks and operators, and an executor may have several that wait. keeps: drops what the operator
    remembers from task to task; it is called when the worker's next task is another operator's.
    """
    for drop in [k for k in KEPT if k != keeps]:
        drop()
    KEPT[:] = [keeps] if keeps else []
    try:
        yield from results
    finally:
        HASHES.clear()
        pa.default_memory_pool().release_unused()
        # Only some C libraries have it.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def hashes_of(raw: bytes, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxh64 of the parts of raw that begin at first and have sizes bytes, as xxhash.xxh64_intdigest has it."""
    out = np.empty(len(first), np.uint64)
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _PRIMES)
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(raw) + 1, 8), (1, 1))
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    borders = np.searchsorted(np.minimum(sizes, 32)[order], np.arange(34))
    for size in range(32):
        who = order[borders[size] : borders[size + 1]]
        if not len(who):
            continue
        at, left = first[who], size
        h = np.full(len(who), p5 + np.uint64(size), np.uint64)
        while left >= 8:
            h ^= turned(eight[at].view("<u8")[:, 0] * p2, 31) * p1
            h = turned(h, 27) * p1 + p4
            at, left = at + 8, left - 8
        tail = eight[at].view("<u8")[:, 0]
        if left >= 4:
            h ^= (tail & np.uint64(0xFFFFFFFF)) * p1
            h = turned(h, 23) * p2 + p3
            tail, left = tail >> np.uint64(32), left - 4
        for _ in range(left):
            h ^= (tail & np.uint64(0xFF)) * p5
            h = turned(h, 11) * p1
            tail = tail >> np.uint64(8)
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        out[who] = h ^ h >> np.uint64(32)
    for k in order[borders[32] :].tolist():
        out[k] = xxhash.xxh64_intdigest(raw[first[k] : first[k] + sizes[k]])
    return out


def byte_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(words: list) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; empty for fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mixed(out * _STEP + words[i : i + n])
    return mixed(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence as one shingle where it is shorter than k."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingles(words, min(k, len(words))))


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Numbers to xor and odd numbers to multiply with: `count` cheap permutations of 64-bit hashes."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, np.uint64), rng.integers(0, 2**63, count, np.uint64) | np.uint64(1)
