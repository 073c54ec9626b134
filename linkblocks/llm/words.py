"""Vectorised words, word hashes and shingles of UTF-8 bytes.

A word is a longest run of ASCII letters and digits and of bytes from 128 up
(so of all characters beyond ASCII); A-Z count as a-z. Hashes are 64 bit,
depend on the word alone and are the same on every machine.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
IS_WORD = np.zeros(256, bool)
IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first n bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Longer spans are hashed one by one.
LANES = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (multiply and xor-shift)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one integer (zeros after the end); one entry more than bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where in them each row begins (one entry more than rows)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = IS_WORD[data]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z as a-z.

    Eight bytes at a time go through the scrambler together with what came
    before them, so spans of one length up to eight never share a hash; spans
    of over 64 bytes have eight bytes of their BLAKE2 digest.
    """
    if not len(starts):
        return np.empty(0, U)
    low, size = LOWER[data], ends - starts
    view = lanes(low)
    out = mix(mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(1)) ^ (view[starts] & FIRST[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= 8 * LANES))
    for i in range(1, LANES):
        if not len(more):
            break
        out[more] = mix(out[more] * U(0xA0761D6478BD642F) ^ (view[starts[more] + 8 * i] & FIRST[np.minimum(size[more] - 8 * i, 8)]))
        more = more[size[more] > 8 * (i + 1)]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row number of each element, from where rows begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(word_hash: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `size` words within a row; a shorter row that has words makes one shingle of them all."""
    counts = np.diff(bounds)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), runs)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(runs) - runs, runs) + bounds[:-1][rows]
    padded = np.concatenate([word_hash, np.zeros(size, U)])
    total, inside = np.zeros(len(rows), U), counts[rows]
    weight = U(1)
    for k in range(size):
        weight = U((int(weight) * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) % (1 << 64) | 1)
        part = padded[first + k]
        if k:
            part = np.where(inside > k, part, U(0))
        total += part * weight
    return mix(total), rows
