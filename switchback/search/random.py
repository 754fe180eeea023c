"""A portable 64-bit generator (splitmix64) on arrays, for draws that do not depend on a library."""

from __future__ import annotations

import numpy as np

#: Fixed values of the generator.
GAMMA, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def draws(seed: int, n: int) -> np.ndarray:
    """The first ``n`` outputs from ``seed``."""
    state = np.uint64(seed % (1 << 64)) + GAMMA * np.arange(1, n + 1, dtype=np.uint64)
    state = (state ^ (state >> np.uint64(30))) * MIX_A
    state = (state ^ (state >> np.uint64(27))) * MIX_B
    return state ^ (state >> np.uint64(31))


def uniform(seed: int, n: int) -> np.ndarray:
    """Doubles in [0, 1)."""
    return (draws(seed, n) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def normal(seed: int, n: int) -> np.ndarray:
    u = uniform(seed, 2 * n)
    return np.sqrt(-2 * np.log(1 - u[::2])) * np.cos(2 * np.pi * u[1::2])
