"""64-bit hashes of words and of runs of words, computed over a whole text at once."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 256) - 1, _P, np.uint64))))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M2
        return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each word; words hold no byte that is a space."""
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    inside = np.arange(len(raw), dtype=np.int64)
    inside -= np.repeat(start, np.append(size[:-1] + 1, size[-1:]))
    with np.errstate(over="ignore"):
        v = (raw.astype(np.uint64) + np.uint64(1)) * _power_table(int(size.max()) + 1)[inside]
        v[start[1:] - 1] = 0
        return mix(np.add.reduceat(v, start) + size.astype(np.uint64) * _M1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, from the hashes of the words."""
    n = len(h) - k + 1
    if n < 1 or k < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _M1 + h[i : n + i]
        return mix(out)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, ascending; with fewer words the whole sequence is the only one."""
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)
