"""Words of a text and their hashes: runs of letters and digits of any script, lower-cased."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 2_000_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered by the worker; forgotten as a whole when it grows past its bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def distinct_words(*texts: str | None) -> set[str]:
    """The distinct words of several texts together; a null is no text."""
    return set(WORD.findall(" ".join(t for t in texts if t).lower()))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A seeded bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x94D049BB133111EB)


def set_sums(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits naming each set: two sums of differently mixed element hashes, whatever the order."""
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(mix(flat, s), starts).view("int64") for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
