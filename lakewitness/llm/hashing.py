"""Vectorised 64-bit hashing of words and byte windows, for use inside tasks.

Hashes are polynomials modulo 2**64 over a random table of bytes, taken from prefix sums: one pass gives the hash of
any stretch of a text. They are stable over processes and machines.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
C = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, size=256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base, or of its inverse."""
    known = _powers[name]
    if len(known) < n:
        size = max(n, 2 * len(known), 1 << 16)
        steps = np.full(size, _BASE if name == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.multiply.accumulate(steps)
    return known[:n]


_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


class Stretches:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        self.bytes, self.n = b, len(b)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTES[b] * _power("up", self.n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _power("down", self.n + 1)[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the window of ``size`` bytes at every place that has one."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[: self.n - size + 1]) * _power("down", self.n - size + 1) + np.uint64(size))


def word_hashes(data: bytes, is_word: np.ndarray) -> np.ndarray:
    """Hashes of the maximal runs of bytes that the table ``is_word`` marks."""
    if not data:
        return np.zeros(0, np.uint64)
    s = Stretches(data)
    inside = np.zeros(s.n + 2, np.int8)
    inside[1:-1] = is_word[s.bytes]
    edge = np.diff(inside)
    return s.hashes(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def ngrams(words: np.ndarray, offsets: tuple[int, ...], salt: int) -> np.ndarray:
    """Hashes of the words at i + each offset, for every i that has them all."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(salt), np.uint64)
    for j, o in enumerate(offsets):
        total += words[o : o + n] * C[j]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
