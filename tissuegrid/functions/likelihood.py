"""Count likelihood with a log-normal rate: ``P(Y = k | x) = E[Poisson(k; x * exp(sigma * Z))]``.

The table over a fixed rate grid is computed from this definition (published robust
decomposition model), once per sigma, and interpolated linearly between grid rates.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the table layout.
N_RATES = 2536
N_COUNTS = 103
MAX_COUNT = N_COUNTS - 3
DELTA = 1e-5
EPSILON = 1e-4
DENSE_RATES = 900
COARSE_STEP = 30

SIGMAS = np.concatenate([np.arange(10, 71), np.arange(72, 202, 2)])  # in hundredths

Z_LIMIT = 6.0
TINY = 1e-300


def rate_grid() -> np.ndarray:
    i = np.arange(1, N_RATES + 1, dtype=float)
    steps = np.minimum(i, DENSE_RATES) + np.maximum(i - DENSE_RATES, 0) * COARSE_STEP
    return DELTA * steps ** 1.5


def quadrature(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the standard normal: equal steps converge fast for smooth integrands.

    Steps stay well below the width of the sharpest Poisson peak on the log-rate axis.
    """
    n = max(61, int(np.ceil(2 * sigma)) + 1)
    z = np.linspace(-Z_LIMIT, Z_LIMIT, n)
    w = np.exp(-z * z / 2)
    return z, w / w.sum()


@lru_cache(maxsize=20)
def count_table(sigma: int) -> np.ndarray:
    """``N_COUNTS x N_RATES`` probabilities for ``sigma`` in hundredths."""
    z, w = quadrature(sigma)
    rate = rate_grid()[:, None] * np.exp(sigma / 100.0 * z)[None, :]
    term = np.exp(-rate)
    table = np.empty((N_COUNTS, N_RATES))
    for k in range(N_COUNTS):
        table[k] = term @ w
        term *= rate / (k + 1)
    return np.maximum(table, TINY)


def locate(x: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower grid position of each clamped rate and the weight of that position."""
    x = np.clip(x, EPSILON, grid[-1] - EPSILON)
    raw = np.floor((x / DELTA) ** (2 / 3))
    low = (np.minimum(raw, DENSE_RATES) + np.floor(np.maximum(raw - DENSE_RATES, 0) / COARSE_STEP) - 1).astype(int)
    return low, (grid[low + 1] - x) / (grid[low + 1] - grid[low])


def interpolate(table: np.ndarray, k: np.ndarray, low: np.ndarray, share: np.ndarray) -> np.ndarray:
    return share * table[k, low] + (1 - share) * table[k, low + 1]


def probability(x, y, table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    low, share = locate(np.asarray(x, float), grid)
    return interpolate(table, np.minimum(np.asarray(y), MAX_COUNT).astype(int), low, share)


def log_derivatives(x, y, table: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of ``ln P(Y = y | x)`` in ``x``.

    Poisson derivatives only involve neighbouring counts, so the three table rows suffice.
    """
    x = np.clip(np.asarray(x, float), EPSILON, grid[-1] - EPSILON)
    k = np.minimum(np.asarray(y), MAX_COUNT).astype(int)
    low, share = locate(x, grid)
    p0, p1, p2 = (interpolate(table, k + i, low, share) for i in range(3))
    first = (k * p0 - (k + 1) * p1) / x
    second = (k * (k - 1) * p0 - 2 * k * (k + 1) * p1 + (k + 1) * (k + 2) * p2) / (x * x)
    slope = first / p0
    return slope, second / p0 - slope * slope
