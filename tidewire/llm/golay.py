"""Fuzzy hashing with the perfect binary Golay code [23, 12, 7]."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code.
GENERATOR = 0b101011100011
WORD_BITS = 23


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and per syndrome the error patterns of weight up to 4 (6 at most, else -1).

    The code is perfect with radius 3, so each coset has one pattern of weight 3 or less; cosets whose
    lightest pattern has weight 3 have five of weight 4 as well.
    """
    bits = []
    for i in range(WORD_BITS):
        rest = 1 << i
        for j in range(WORD_BITS - 1, 10, -1):
            if rest >> j & 1:
                rest ^= GENERATOR << (j - 11)
        bits.append(rest)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(WORD_BITS), weight):
            syndrome = word = 0
            for p in places:
                syndrome ^= bits[p]
                word |= 1 << p
            patterns[syndrome].append(word)
    width = max(map(len, patterns))
    return np.array(bits, np.int64), np.array([p + [-1] * (width - len(p)) for p in patterns], np.int64)


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of all codewords within distance 4 (one to six; else -1).

    Two words at distance 2 or less have an index in common: the codeword nearest to a word between
    them is within 3 of it and so within 4 of both.
    """
    bits, patterns = tables()
    words = np.asarray(words, dtype=np.int64)
    syndrome = np.zeros(len(words), dtype=np.int64)
    for i in range(WORD_BITS):
        syndrome ^= np.where(words >> i & 1, bits[i], 0)
    errors = patterns[syndrome]
    # Systematic: the upper 12 bits tell codewords apart.
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)
