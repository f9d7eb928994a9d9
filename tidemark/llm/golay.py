"""The perfect (23, 12) Golay code: 4,096 words of 23 bits, any two of which differ in seven bits or more."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: The code's generator polynomial, and the length of its words and checks.
GENERATOR, LENGTH, CHECKS = 0xC75, 23, 11


def _remainder(v: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - CHECKS)
    return v


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each value of the upper twelve bits, and for each remainder what to add to these bits to get the
    indices of the codewords within four bits: one, or six; the rest of a line repeats its first."""
    checks = np.array([_remainder(i << CHECKS) for i in range(1 << (LENGTH - CHECKS))], np.int64)
    one = [_remainder(1 << b) for b in range(LENGTH)]
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            error = syndrome = 0
            for b in bits:
                error |= 1 << b
                syndrome ^= one[b]
            found[syndrome].append(error >> CHECKS)
    return checks, np.array([x + x[:1] * (6 - len(x)) for x in found], np.int64)


def indices(words: np.ndarray, made: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6): indices of the codewords near each word of up to 23 bits."""
    upper = words >> CHECKS
    return upper[:, None] ^ made[1][made[0][upper] ^ (words & ((1 << CHECKS) - 1))]


def signs() -> np.ndarray:
    """(23, 4096): all codewords, with 1 for a set bit and -1 for another."""
    index = np.arange(1 << (LENGTH - CHECKS))
    words = index << CHECKS | tables()[0]
    return (2.0 * (words >> np.arange(LENGTH)[:, None] & 1) - 1.0).astype(np.float32)


def two_nearest(sums: np.ndarray, code: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """(n, 2): indices of the two codewords that agree best with sums (n, 23), whose signs are bits and whose sizes say how
    sure each bit is."""
    out = np.empty((len(sums), 2), np.int64)
    for a in range(0, len(sums), at_once):
        agree = sums[a : a + at_once].astype(np.float32) @ code
        rows = np.arange(len(agree))
        out[a : a + at_once, 0] = first = agree.argmax(axis=1)
        agree[rows, first] = -np.inf
        out[a : a + at_once, 1] = agree.argmax(axis=1)
    return out
