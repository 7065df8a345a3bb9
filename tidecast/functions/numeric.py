"""Numpy helpers for work inside tasks: lag matrices, least squares, small recursions.

Each function handles one block of one series or one small matrix; Spark decides how many run and
where.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# MacKinnon's response surface for the unit-root statistic with a constant.
TAU_MIN = -18.83
TAU_STAR = -1.61
TAU_MAX = 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

NORMAL = NormalDist()


def normal_tail_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in np.atleast_1d(z)])


def chi_square_tail(statistic: float, degrees: int) -> float:
    """Upper tail for any whole number of degrees."""
    x = statistic / 2.0
    if degrees % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / i
            total += term
        return math.exp(-x) * total
    total = math.erfc(math.sqrt(x))
    for i in range(1, (degrees - 1) // 2 + 1):
        total += math.exp(-x + (i - 0.5) * math.log(x) - math.lgamma(i + 0.5)) if x > 0 else 0.0
    return total


def unit_root_p_value(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coefficients = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    return NORMAL.cdf(sum(c * tau**i for i, c in enumerate(coefficients)))


def lagged(x: np.ndarray, lags) -> np.ndarray:
    """Matrix with one column per lag; cells before the array starts are NaN."""
    out = np.full((len(x), len(lags)), np.nan)
    for j, k in enumerate(lags):
        if k < len(x):
            out[k:, j] = x[: len(x) - k]
    return out


def difference(x: np.ndarray, d: int, seasonal_d: int, season: int) -> np.ndarray:
    """Apply both differences along the first axis; undefined leading cells are NaN."""
    out = np.asarray(x, dtype=float).copy()
    for lag in [1] * d + [season] * seasonal_d:
        shifted = np.full_like(out, np.nan)
        if lag < len(out):
            shifted[lag:] = out[:-lag]
        out = out - shifted
    return out


def gram(matrix: np.ndarray) -> np.ndarray:
    """Cross products of the complete rows, flattened."""
    return (matrix.T @ matrix).ravel()


def square(flat) -> np.ndarray:
    flat = np.asarray(flat, dtype=float)
    size = math.isqrt(len(flat))
    return flat.reshape(size, size)


def gaussian_scores(ssr: float, rows: int, parameters: int) -> tuple[float, float, float]:
    """Log-likelihood, AIC and BIC of a least-squares fit with normal errors."""
    loglik = -0.5 * rows * (math.log(2.0 * math.pi) + math.log(ssr / rows) + 1.0)
    return loglik, 2.0 * parameters - 2.0 * loglik, parameters * math.log(rows) - 2.0 * loglik


def partial_autocorrelations(acf: np.ndarray) -> np.ndarray:
    """Durbin-Levinson over autocorrelations at lags 0, 1, ...; one result per lag."""
    order = len(acf) - 1
    out = np.zeros(order + 1)
    out[0] = 1.0
    phi = np.zeros(order + 1)
    error = 1.0
    for k in range(1, order + 1):
        if error <= 0:
            out[k:] = np.nan
            break
        value = (acf[k] - phi[1:k] @ acf[k - 1 : 0 : -1]) / error
        head = phi[1:k] - value * phi[k - 1 : 0 : -1]
        phi[1:k] = head
        phi[k] = value
        error *= 1.0 - value * value
        out[k] = value
    return out


def exact_parts(x: np.ndarray) -> np.ndarray:
    """``x`` as multiples of 2**-20 followed by the rest as multiples of 2**-60.

    Sums of either are exact, whatever their order, for up to 2**14 arrays and totals below 2**33.
    """
    upper = np.round(x * 2.0**20) / 2.0**20
    return np.concatenate([upper, np.round((x - upper) * 2.0**60) / 2.0**60])


class Partials:
    """Sums arrays per key inside one task, holding at most ``limit`` keys at a time.

    What a task emits then grows with the keys it sees, not with its blocks. Keys that come back
    after a drain are simply emitted again and summed by Spark.
    """

    def __init__(self, limit: int = 64) -> None:
        self.limit = limit
        self.cells: dict = {}

    def add(self, key: tuple, counts: tuple, flat: np.ndarray, kept: tuple = ()) -> None:
        found = self.cells.get(key)
        if found is None:
            self.cells[key] = (np.asarray(counts), flat, kept)
            return
        merged = tuple(b if a is None else a for a, b in zip(found[2], kept))
        self.cells[key] = (found[0] + counts, found[1] + flat, merged)

    def full(self) -> bool:
        return len(self.cells) >= self.limit

    def drain(self) -> list[tuple]:
        rows = [
            (*key, *(int(c) for c in counts), flat, *kept)
            for key, (counts, flat, kept) in self.cells.items()
        ]
        self.cells = {}
        return rows
