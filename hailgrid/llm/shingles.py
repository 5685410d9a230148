"""Word shingles of a text as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHED_WORDS = 300_000


class _WordHashes(dict):
    """Hashes of the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over 64 bits; another seed gives other values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingles of ``n`` words: A to Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; one without words or a null has none.
    """

    def __init__(self, n: int):
        self.n = n
        self._words = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct shingles, sorted."""
        if not text:
            return np.empty(0, dtype=np.uint64)
        split = text.encode("utf-8", "surrogatepass").lower().split()
        if not split:
            return np.empty(0, dtype=np.uint64)
        words = np.fromiter(map(self._words.__getitem__, split), dtype=np.uint64, count=len(split))
        length = min(self.n, len(words))
        with np.errstate(over="ignore"):
            rolled = words[: len(words) - length + 1].copy()
            for j in range(1, length):
                rolled = rolled * _MULTIPLIER + words[j : len(words) - length + 1 + j]
        return np.unique(mix(rolled, length))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed longs."""
    parts = (mix(shingles, 11).sum(dtype=np.uint64), mix(shingles, 13).sum(dtype=np.uint64))
    return tuple(int(x.astype(np.int64)) for x in parts)
