"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .common import joined_bytes, mix64

WORDS = 5
#: bytes hashed at a time; a cut falls on white space
BLOCK = 1 << 20
# fixed odd multipliers of the polynomial hashes
P, M = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, P, np.uint64)
    down = np.full(n + 1, pow(P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _block_words(data: np.ndarray, breaks: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a block that cuts no word."""
    solid = ~space
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(solid & (before | breaks[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(solid & (after | breaks[1:])) + 1
    size = BLOCK if len(data) <= BLOCK else 1 << int(len(data) - 1).bit_length()
    up, down = _powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix64(h + (ends - starts).astype(np.uint64) * np.uint64(M))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, text after text, and the n+1 offsets of the texts in them."""
    data, offsets = joined_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    places, hashes, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data):  # back to a cut between words, or on to the next one
            cuts = np.flatnonzero(space[at:stop] | breaks[at + 1 : stop + 1])
            if len(cuts):
                stop = at + int(cuts[-1]) + 1
                break
            stop = min(len(data), stop + BLOCK)
        s, h = _block_words(_LOWER[data[at:stop]], breaks[at : stop + 1], space[at:stop])
        places.append(s + at)
        hashes.append(h)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer than WORDS words the whole sequence is one."""
    words, offsets = word_hashes(texts)
    m = [np.uint64(pow(M, k, 1 << 64)) for k in range(WORDS)]
    n = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled += words[k : k + n] * m[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(P) + w
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(rolled[:0])
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = np.add.reduce(mix64(s ^ np.uint64(P))), np.add.reduce(mix64(s + np.uint64(M)))
    return int(np.int64(np.uint64(a).astype(np.int64))), int(np.uint64(b).astype(np.int64))
