"""Sets of hashed word shingles, computed on whole arrays of bytes.

A-Z count as a-z; words are what stands between blanks (space, tab to carriage return). A document's set holds the 64-bit
hashes of its distinct runs of n words; with fewer words, the hash of the whole sequence; without words it is empty.
"""

from __future__ import annotations

import numpy as np

_BASE, _SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PART = 1 << 17
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _words(part: np.ndarray) -> np.ndarray:
    n = len(part)
    power, inverse = _power(max(n, _PART))
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[part]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, in order. Long texts are read in parts that end at a blank."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if len(data) <= _PART:
        return _words(data)
    out, at = [], 0
    while at < len(data):
        size = _PART
        while True:
            stop = min(at + size, len(data))
            blanks = np.flatnonzero(_BLANK[data[at:stop]])
            if stop == len(data) or len(blanks):
                break
            size *= 2
        if stop < len(data):
            stop = at + int(blanks[-1]) + 1
        out.append(_words(data[at:stop]))
        at = stop
    return np.concatenate(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The set as a sorted array of uint64."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    size = min(n, len(words))
    if not size:
        return words
    last = len(words) - size + 1
    h = np.full(last, size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + words[k : k + last]
        h ^= h >> np.uint64(31)
    h = np.sort(mix(h * np.uint64(_SEED)))
    fresh = np.ones(last, dtype=bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]
