"""Words and word runs: a word is a longest run of Unicode letters or digits, lower-cased."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hash64(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose values behave like independent draws."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of words, kept for the words met since the store last grew too large."""

    def __init__(self, keep: int = 500_000):
        self.keep, self.seen = keep, {}

    def of(self, ws: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        out = np.empty(len(ws), dtype=np.uint64)
        for i, w in enumerate(ws):
            h = seen.get(w)
            if h is None:
                h = seen[w] = hash64(w)
            out[i] = h
        return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, in order; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out) + h[k : len(h) - n + 1 + k]
    return mix(out)
