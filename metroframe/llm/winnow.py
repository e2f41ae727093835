"""Hashes of bytes, words and runs of them, and content-defined anchors.

A run's hash is a polynomial modulo 2^64 over the hashes of its units, taken from running sums, so that all runs of one
length cost the same few passes. The anchor of a window of consecutive units is the run of k units in it with the least
hash (the first of equal ones); it depends on the window's content alone, so equal windows have equal anchors at equal
places, wherever they stand.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
#: A random value for every byte.
BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Windows looked at together.
STEP = 1 << 22
_PLACE = np.uint64(24)  # bits for a place among the runs of a step

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(b, m, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(units: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * powers(len(units))[0])])


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = sums(units)
    return mixed((s[k:] - s[:n]) * powers(n)[1])


def byte_units(raw: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(raw, np.uint8)]


def word_units(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, starts and ends of the words of raw, which ASCII white space parts."""
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    s = sums(BYTES[b])
    h = (s[ends] - s[starts]) * powers(len(b))[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64)), starts, ends


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    size = 1
    while 2 * size <= w:
        a = np.minimum(a[: len(a) - size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def anchors(units: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For windows of so many consecutive units: hash and place of each anchor, and the first and last window that it anchors."""
    found = []
    for begin in range(0, len(units) - window + 1, STEP):
        part = units[begin : begin + STEP + window - 1]
        h = grams(part, k)
        keyed = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keyed, window - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        runs = np.flatnonzero(np.diff(at, prepend=-1))
        found.append((h[at[runs]], at[runs] + begin, runs + begin, np.append(runs[1:], len(at)) - 1 + begin))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(c) for c in zip(*found))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
