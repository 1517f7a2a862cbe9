"""Words, word hashes and shingles of a text with whole-array operations.

A word is a maximal run without ASCII white space.  Its 64-bit hash is a
polynomial over its bytes, ASCII letters folded to lower case, computed for all
words of a text from one running sum.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; bounds the working memory for very long texts.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        _cache["up"], _cache["down"] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _cache["up"], _cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in an array of bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def _hash_chunk(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word; a word longer than a chunk is hashed by itself."""
    if len(raw) <= CHUNK:
        return _hash_chunk(raw, begin, end)
    parts, at = [], 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + CHUNK, side="right")))
        base = begin[at]
        parts.append(_hash_chunk(raw[base : end[stop - 1]], begin[at:stop] - base, end[at:stop] - base))
        at = stop
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return word_hashes(raw, *spans(raw))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words, repeats included; all words as one run if fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)


def occurrences(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    return np.unique(values, return_counts=True)
