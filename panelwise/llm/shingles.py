"""Hashes of word shingles, many documents at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes of text that are hashed in one go.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values; a permutation."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _POWERS["up"], _POWERS["down"]


def _hashed(word_lists: list[list[bytes]], k: int) -> list[np.ndarray]:
    counts = np.array([len(w) for w in word_lists])
    flat = [x for w in word_lists for x in w]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(word_lists)
    buf = np.frombuffer(b" ".join(flat), np.uint8)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_POWERS["bytes"][buf] * up[: len(buf)], out=total[1:])
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    end = np.cumsum(size + 1) - 1
    start = end - size
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(flat)) - first[doc]
    width = np.minimum(counts, k)[doc]
    at = np.flatnonzero(place + width <= counts[doc])
    s, e = start[at], end[at + width[at] - 1]
    h = mix((total[e] - total[s]) * down[s])
    return np.split(h, np.cumsum(np.maximum(np.minimum(counts, 1), counts - k + 1))[:-1])


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a text of fewer words is one shingle.

    Words are what ASCII white space separates, lower-cased in A-Z. Null and empty texts have no shingles.
    """
    lists, size = [], 0
    for t in texts:
        lists.append((t or b"").lower().split())
        size += len(t or b"")
        if size > CHUNK:
            yield from map(np.unique, _hashed(lists, k))
            lists, size = [], 0
    yield from map(np.unique, _hashed(lists, k) if lists else [])
