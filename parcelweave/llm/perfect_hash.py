"""A minimal perfect hash over integer keys, as bytes: bit arrays by level, ranks, and one entry for each key.

Level by level every key left falls on a place of an array twice their number; a place hit once is its
key's, and the others go on.  The rank of a place among all places taken is the key's number, so n keys
have the numbers 0 to n-1.  An entry holds a fingerprint of the key, which tells a foreign key, and the
columns stored for it.  Looking up a key reads one bit for each level it passes, one rank, one entry.

Keys are (id, copy).  Keys that agree in their 64-bit hash pass all levels; they are listed by value.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

MAGIC = 0x31_48_50_4D
#: places for each key left, and levels after which keys are listed
SPARE, LEVELS = 2, 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64-bit hash of the keys; equal for no two ids with the same copy number."""
    with np.errstate(over="ignore"):
        return mix64(ids.astype(np.int64).view(np.uint64) + _STEP) ^ mix64(copies.astype(np.int64).view(np.uint64) * _STEP)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h + _STEP * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h ^ _STEP) >> np.uint64(32)).astype(np.uint32)


def _padded(a: np.ndarray) -> bytes:
    b = a.tobytes()
    return b + bytes(-len(b) % 8)


def build(ids: np.ndarray, copies: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """The index of distinct keys; ``columns`` are unsigned 64-bit values stored for each."""
    h = hashed(ids, copies)
    left, number, taken = np.arange(len(h)), np.full(len(h), -1, np.int64), 0
    sizes, words = [], []
    while len(left) and len(sizes) < LEVELS:
        size = -(-len(left) * SPARE // 64) * 64
        place = _place(h[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        number[left[alone[place]]] = taken + np.cumsum(alone)[place[alone[place]]] - 1
        taken += int(alone.sum())
        left = left[~alone[place]]
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
    number[left] = taken + np.arange(len(left))
    words = np.concatenate([np.zeros(0, np.uint64), *words])
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[: len(words)].astype(np.uint32)
    order = np.argsort(number)
    head = np.array([MAGIC, len(h), len(sizes), len(words), len(left), len(columns)], np.int64)
    return b"".join([head.tobytes(), np.array(sizes, np.int64).tobytes(), words.tobytes(), _padded(ranks), _padded(np.stack([ids[left], copies[left]]).astype(np.int64)),
                     _padded(fingerprints(h)[order]), *(np.asarray(c, np.uint64)[order].tobytes() for c in columns)])


class Index:
    """A built index, read in place."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, np.int64, 6)
        if head[0] != MAGIC:
            raise ValueError("no index")
        self.n, levels, words, listed, columns = (int(x) for x in head[1:])
        at = 48

        def part(kind, count):
            nonlocal at
            a = np.frombuffer(data, kind, count, at)
            at += -(-a.nbytes // 8) * 8
            return a

        self.sizes, self.words, self.ranks = part(np.int64, levels), part(np.uint64, words), part(np.uint32, words)
        self.listed = part(np.int64, 2 * listed).reshape(2, -1)
        self.marks = part(np.uint32, self.n)
        self.columns = [part(np.uint64, self.n) for _ in range(columns)]

    def numbers(self, ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        h = hashed(ids, copies)
        number, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = _place(h[left], level, size)
            word, bit = base // 64 + place // 64, (place % 64).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            number[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        number[number >= 0] = np.where(self.marks[number[number >= 0]] == fingerprints(h)[number >= 0], number[number >= 0], -1)
        for k in left if self.listed.size else ():
            same = np.flatnonzero((self.listed[0] == ids[k]) & (self.listed[1] == copies[k]))
            if len(same):
                number[k] = self.n - self.listed.shape[1] + same[0]
        return number

    def find(self, ids: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
        """Whether each key is there, and its stored columns (0 where it is not)."""
        number = self.numbers(ids, copies)
        here = number >= 0
        if not self.n:
            return [here, *(np.zeros(len(here), np.uint64) for _ in self.columns)]
        return [here, *(np.where(here, c[number], np.uint64(0)) for c in self.columns)]
