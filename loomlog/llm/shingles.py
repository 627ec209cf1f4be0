"""Word shingles as 64-bit hashes, for the operators on near duplicates.

Words are the runs of letters and digits of the lower-cased text. A text of fewer
words than a shingle has one shingle of all of them; one without words has none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from . import caches

SIZE = 5
words = re.compile(r"[^\W_]+").findall

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000 and len(word) <= 32:
            self[word] = h
        return h


_hashes = _Hashes()
_hash = _hashes.__getitem__
caches.register("shingles", _hashes.clear)


def word_hashes(text: str) -> np.ndarray:
    held = words(text.lower())
    return np.fromiter(map(_hash, held), np.uint64, len(held))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sequence(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The hash of the shingle that starts at each word."""
    size = min(size, len(h))
    if size == 0:
        return h
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _FACTOR + h[k : k + n]
    return mixed(out)


def distinct(text: str, size: int = SIZE) -> np.ndarray:
    """The sorted set of a text's shingles."""
    return np.unique(sequence(word_hashes(text), size))


class MinHash:
    """``bands`` hashes of ``rows`` minima each; with a threshold and a recall, the
    widest rows whose bands fit into ``most`` permutations."""

    def __init__(self, threshold: float = 0.8, recall: float = 0.999, most: int = 128, seed: int = 7):
        fits = [(r, b) for r in range(1, most + 1) if (b := int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**r)))) if threshold < 1 else 1) * r <= most]
        self.rows, self.bands = max(fits)
        draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, self.rows * self.bands, 1), dtype=np.uint64)
        self.flip, self.factor = draw[0], draw[1] | np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.flip), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            np.minimum(low, ((shingles[None, at : at + 2048] ^ self.flip) * self.factor).min(axis=1), out=low)
        return low

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """One hash for each band, with the band's number mixed in."""
        low = self.minima(shingles).reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            out = mixed(out * _FACTOR + low[:, k])
        return out
