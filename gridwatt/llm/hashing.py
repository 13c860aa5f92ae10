"""64-bit hashes of words, shingles and byte windows, computed on whole batches."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

# A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# what separates words: space and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A well spread permutation of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    k, step = 1, base & _MASK
    while k < n:
        m = min(k, n - k)
        np.multiply(out[:m], np.uint64(step), out=out[k:k + m])
        step = step * step & _MASK
        k *= 2
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a run of texts, and the number of words of each text."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]  # words end with their text
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    at = np.flatnonzero(solid)
    begin = np.flatnonzero(first[at])
    length = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, length)
    value = (LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
    h = np.add.reduceat(value, begin)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; the whole sequence as one if it has fewer, none if it is empty."""
    n = len(words)
    if n == 0:
        return words
    k = powers(width + 1, 0xA24BAED4963EE407)[1:] | np.uint64(1)
    if n < width:
        return mix(np.array([(words * k[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = words[:n - width + 1] * k[0]
    for j in range(1, width):
        out = out + words[j:n - width + 1 + j] * k[j]
    return mix(out)
