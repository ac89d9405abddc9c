"""Polynomial prefix hashes modulo 2^64: the hash of any substring of a buffer by two look-ups, for whole arrays of substrings."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; `seed` selects one of many."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            step = np.full(size, BASE, np.uint64)
            step[0] = 1
            _powers = np.multiply.accumulate(step)
            step = np.full(size, INVERSE, np.uint64)
            step[0] = 1
            _inverses = np.multiply.accumulate(step)


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] the weighted sum of the first i values."""
    _grow(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[: len(values)], out=out[1:])
    return out


def hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal substrings have equal hashes wherever they stand."""
    return mix((p[end] - p[start]) * _inverses[start])


def windows(p: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k values."""
    n = max(len(p) - k, 0)
    return mix((p[k:] - p[:n]) * _inverses[:n])


def occurrences(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many equal hashes of the same row stand before each one."""
    own = mix(h ^ mix(row.astype(np.uint64), 7))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    at = np.arange(len(own))
    label = np.empty(len(own), np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return label
