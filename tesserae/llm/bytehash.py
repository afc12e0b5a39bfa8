"""Hashes of words and of byte windows, computed by numpy over whole texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once.
BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values; different salts give independent orders."""
    x = x + _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of byte k times base^k for i <= k < j."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, wherever they stand."""
    _, down = _powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of ``width`` bytes."""
    sums = prefix_sums(data)
    _, down = _powers(len(sums))
    n = len(data) - width + 1
    return (sums[width:] - sums[:-width]) * down[:n] if n > 0 else np.empty(0, _U)


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A hash for each word (run of bytes other than ASCII white space), in order."""
    out = []
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):  # a block ends between words
            while end < len(text) and not _GAP[text[end]]:
                end += 1
        data = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        if lower:
            data = _LOWER[data]
        inside = np.concatenate([[False], ~_GAP[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[::2], edges[1::2]
        if len(start):
            out.append(mix(range_hashes(prefix_sums(data), start, stop) + (stop - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
        at = end
    return np.concatenate(out) if out else np.empty(0, _U)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The distinct hashes of n-word shingles, sorted; fewer words make one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    made = np.full(count, _U(width))
    for k in range(width):
        made = mix(made * _U(0x9E3779B97F4A7C15) + words[k : k + count], k)
    return np.unique(made)
