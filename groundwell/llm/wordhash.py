"""Words of many texts as 64-bit hashes, computed with arrays instead of word by word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_WORD_BYTE = np.zeros(256, dtype=bool)  # letters and digits; any byte beyond ASCII counts as a letter
_WORD_BYTE[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit value."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); letters are taken in lower case."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = np.concatenate([[False], _WORD_BYTE[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, counts


def grams(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words within one text, its first word's place in ``hashes``)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * _BASE + hashes[k : k + n]
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(h[at]), at
