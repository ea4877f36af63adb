"""The binary Golay code of length 23: 4096 codewords, every vector within 3 bits of exactly one.

A vector at 3 bits from its nearest codeword lies at 4 bits from five others. With these, every vector has one or six
codewords nearby, and any two vectors that differ in at most two bits share one of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

N, K = 23, 12
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _syndrome(v: int) -> int:
    for i in range(N - 1, N - K - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - (N - K))
    return v


#: Syndromes of the low and high halves of a vector, to be joined by xor.
LOW = np.array([_syndrome(v) for v in range(1 << 12)], np.int64)
HIGH = np.array([_syndrome(v << 12) for v in range(1 << 11)], np.int64)


def syndrome(v: np.ndarray) -> np.ndarray:
    return LOW[v & 0xFFF] ^ HIGH[v >> 12]


def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the differences to the nearby codewords (six columns, repeated where there is but one), and how many."""
    out, count = np.zeros((1 << (N - K), 6), np.int64), np.zeros(1 << (N - K), np.int64)
    by_weight = {w: np.array([sum(1 << i for i in c) for c in combinations(range(N), w)], np.int64) for w in (0, 1, 2, 3, 4)}
    for w in (0, 1, 2, 3):
        s = syndrome(by_weight[w])
        out[s], count[s] = by_weight[w][:, None], 1
    four = by_weight[4]
    s = syndrome(four)
    for e, k in zip(four.tolist(), s.tolist()):
        if out[k, 0].item().bit_count() == 3:
            out[k, count[k]] = e
            count[k] += 1
    return out, count


ERRORS, COUNT = _errors()


def nearby(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords near each 23-bit vector: six columns, and which of them count."""
    s = syndrome(v)
    return (v[:, None] ^ ERRORS[s]) >> (N - K), np.arange(6) < COUNT[s][:, None]
