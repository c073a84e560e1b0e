"""Vectorised 64-bit hashes of the words in a byte buffer."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two polynomial hashes of a word.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_HELD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, modulo 2^64."""
    have = _HELD.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        have = both[0], both[1]
        if n <= 1 << 20:
            _HELD[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _visible() -> np.ndarray:
    table = np.ones(256, bool)
    table[9:14] = table[32] = False
    return table


LOWER, VISIBLE = _lower(), _visible()


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The begin of each word ``[^\\x20\\x09-\\x0D]+`` of ``data`` (bytes that end in white space), and its
    hash with A-Z lower-cased: differences of running sums of two polynomials, mixed."""
    seen = VISIBLE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], seen])))
    begin, end = edges[::2], edges[1::2]
    words = np.zeros(len(begin), np.uint64)
    values = LOWER[data].astype(np.uint64) + np.uint64(1)
    for base in BASES:
        up, down = powers(base, len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(data)])])
        words = mix(words * np.uint64(BASES[1]) + (total[end] - total[begin]) * down[begin])
    return begin, words
