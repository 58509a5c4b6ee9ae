"""Hashes of many byte ranges at once, from prefix sums modulo 2^64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_CACHED = 1 << 21


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _made(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _cached() -> tuple[np.ndarray, np.ndarray]:
    return _made(_CACHED)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``size`` at least."""
    return _cached() if size <= _CACHED else _made(size)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][:len(data)], out=sums[1:])
    return sums


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range ``data[start:end]``; equal ranges have equal hashes."""
    sums = prefix_sums(data)
    return mixed((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` successive bytes."""
    sums = prefix_sums(data)
    count = len(data) - gram + 1
    return mixed((sums[gram:] - sums[:count]) * powers(len(data))[1][:count])
