"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_KEPT_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads them."""
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct shingles of a text, ascending.

    Words are what lies between ASCII white space, A-Z lower-cased.  A text of fewer words than a
    shingle has its whole sequence as the only one; a text without words has none.
    """

    def __init__(self, size: int = 5):
        self.size = size
        self.kept: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        found = xxhash.xxh3_64_digest(word)
        if len(word) <= 64:
            self.kept[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        words, kept = text.encode().lower().split(), self.kept
        if len(kept) > MAX_KEPT_WORDS:
            kept.clear()
        hashes = np.frombuffer(b"".join([kept.get(w) or self._word(w) for w in words]), ">u8").astype(
            np.uint64)
        if not len(hashes):
            return hashes
        size = min(self.size, len(hashes))
        count = len(hashes) - size + 1
        total = np.full(count, size, np.uint64)
        for i in range(size):
            total = total * _MIX + hashes[i:i + count]
        total = mixed(total)
        total.sort()
        if count > 1:
            fresh = np.ones(count, bool)
            np.not_equal(total[1:], total[:-1], out=fresh[1:])
            total = total[fresh]
        return total
