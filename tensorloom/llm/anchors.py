"""Hashes of byte strings inside a buffer, and anchors: positions that equal passages mark alike."""

from __future__ import annotations

import numpy as np

#: Bytes that an anchor's own hash covers, and successive such hashes of which the smallest marks an anchor.
GRAM, WINDOW = 16, 64
_VALUES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """64-bit hashes of any strings of a buffer, from running sums of a polynomial modulo 2**64."""

    def __init__(self, buffer: np.ndarray) -> None:
        n = len(buffer) + 1
        up, self.back = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
        up[0] = self.back[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(self.back, out=self.back)
        up[:-1] *= _VALUES[buffer]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def anchors(buffer: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions whose 16-byte hash is the smallest of 64 successive ones; ``ends`` are the ends of the texts in the buffer.

    Wherever two texts have the same 79 bytes, they have an anchor at the same
    place among the first 64 of them.
    """
    n = len(buffer)
    if n < GRAM:
        return np.zeros(0, np.int64)
    x = buffer.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    h = mixed(x[:-8] * np.uint64(_BASE) + (x[8:] ^ (x[8:] >> np.uint64(31))))
    low = h
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
    # Windows that run from one text into the next mark nothing: a text's anchors are its own.
    crossing = (ends[:-1, None] - np.arange(1, WINDOW + GRAM - 1)).ravel()
    low[crossing[(crossing >= 0) & (crossing < len(low))]] = 0
    if not len(low):
        return np.zeros(0, np.int64)
    high = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)])
    for step in (1, 2, 4, 8, 16, 32):
        high = np.maximum(high[:-step], high[step:])
    return np.flatnonzero(h == high)
