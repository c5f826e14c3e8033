"""Vectorised hashes of the words and byte runs of a text, given as an array of bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        _powers = np.full(size, BASE, np.uint64)
        _inverse = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.multiply.accumulate(_powers), np.multiply.accumulate(_inverse)
    return _powers[:n], _inverse[:n]


def byte_ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n bytes."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    m, h = len(data) - n + 1, np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        h = (h << np.uint64(8)) | data[k : k + m]
    return (h + np.uint64(n)) * BASE


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that hold no ASCII white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word, from differences of prefix sums."""
    if not len(data):
        return np.empty(0, np.uint64)
    starts, ends = word_bounds(data)
    p, inv = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * inv[starts])


def shingle_counts(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the runs of n words (of fewer, but not none, the one run of all words), and how often each occurs."""
    words = word_hashes(data)
    if not len(words):
        return words, np.empty(0, np.int64)
    n = min(n, len(words))
    m, h = len(words) - n + 1, np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        h = mixed(h * BASE + words[k : k + m])
    return np.unique(h, return_counts=True)


def shingle_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the occurrences of shingles: the k-th occurrence of one has a hash of its own, so that sets of these overlap as the counts do."""
    h, counts = shingle_counts(data, n)
    if len(h) == counts.sum():
        return h
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    every = np.repeat(h, counts)
    return np.unique(np.where(turn == 0, every, mixed(every + turn.astype(np.uint64) * BASE)))
