"""The binary Golay code of length 23: every word lies within 3 bits of exactly one of its 4,096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0xAE3  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
N, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(N - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECKS
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error of weight 3 or less behind each remainder."""
    upper = np.array([_remainder(v << CHECKS) for v in range(1 << N - CHECKS)], dtype=np.uint32)
    error = np.zeros(1 << CHECKS, dtype=np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(N), weight):
            word = sum(1 << b for b in bits)
            error[_remainder(word)] = word
    return upper, error


def index(words: np.ndarray) -> np.ndarray:
    """The number (0 to 4,095) of the codeword nearest to each 23-bit word."""
    upper, error = _tables()
    words = words.astype(np.uint32)
    remainder = upper[words >> np.uint32(CHECKS)] ^ (words & np.uint32((1 << CHECKS) - 1))
    return (words ^ error[remainder]) >> np.uint32(CHECKS)


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codewords within 4 bits of each word: (numbers, which of them are new), both of shape (n, 24).

    They are the nearest codeword and those nearest to the word with one bit turned: 1 or 6 of them.  Words that
    differ in 2 bits or fewer have one in common, and of words that differ in 1 bit, each has the other's nearest.
    """
    turned = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(N, dtype=np.uint32)])
    numbers = np.sort(index(words.astype(np.uint32)[:, None] ^ turned[None, :]), axis=1)
    new = np.ones(numbers.shape, dtype=bool)
    new[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
    return numbers, new
