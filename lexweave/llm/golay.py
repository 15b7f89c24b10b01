"""The binary (23, 12) Golay code: which codewords lie near a segment of a fingerprint.

The code is perfect: every 23-bit word is within three bits of one codeword. The codewords that the word and
its 23 one-bit neighbours decode to are one (if the word is within two bits of a codeword) or six. Two words
that differ in one bit: each one's own codeword is among the other's. In two bits: the sets share a codeword.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, DATA = 23, 12


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator."""
    out = words.astype(np.int64)
    for bit in range(BITS - 1, BITS - DATA - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - BITS + DATA)), out)
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight three at most, and the (up to five, else zero) errors of weight four
    that are one bit beyond an error of weight three."""
    errors = np.array([sum(1 << i for i in c) for w in range(4) for c in combinations(range(BITS), w)], np.int64)
    leader = np.zeros(1 << (BITS - DATA), np.int64)
    leader[syndrome(errors)] = errors
    further = np.zeros((leader.size, 5), np.int64)
    unit = syndrome(1 << np.arange(BITS)).tolist()  # syndromes add up
    for s, error in enumerate(leader.tolist()):
        if error.bit_count() == 3:
            further[s] = sorted({1 << i ^ int(leader[s ^ unit[i]]) for i in range(BITS) if not error >> i & 1})
    return leader, further


def near(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each segment's own codeword index; and of each, five more and whether they exist."""
    leader, further = tables()
    s = syndrome(segments)
    own = (segments ^ leader[s]) >> (BITS - DATA)
    more = (segments[:, None] ^ further[s]) >> (BITS - DATA)
    return own, more, np.broadcast_to((further[s][:, :1] > 0), more.shape)
