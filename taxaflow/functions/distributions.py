"""p-values, which Spark has no functions for: pandas UDFs over one row for each comparison."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def pearson_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees."""
    if r is None or math.isnan(r) or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else beta_inc((n - 2) / 2, 0.5, 1 - r * r)


def _u_counts(n1: int, n2: int) -> list[int]:
    """How many orders of two groups without ties have each U: the coefficients of the product of (1 - x^(n2 + i)) / (1 - x^i)."""
    out = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(len(out) - 1, n2 + i - 1, -1):
            out[u] -= out[u - n2 - i]
        for u in range(i, len(out)):
            out[u] += out[u - i]
    return out


def mann_whitney_p_value(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p. ties: the sum of t^3 - t. Exact if a group has 8 values at most and nothing ties, else normal with both corrections."""
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and ties == 0:
        counts = _u_counts(n1, n2)
        return min(1.0, 2 * sum(counts[math.ceil(u) :]) / sum(counts))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n2 / 2 - 0.5) / math.sqrt(var) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_p_value(None if pd.isna(x) else x, int(k)) for x, k in zip(r, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p_value(u, int(a), int(b), t) for u, a, b, t in zip(u1, n1, n2, ties, strict=True)], dtype="float64")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of values from 1 on: Stirling's series eight steps up, and the steps back."""
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum(np.log(x + i) for i in range(8))


@F.pandas_udf(DoubleType())
def log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    """Log of the binomial coefficient; minus infinity where it is 0."""
    a, b = n.to_numpy(np.float64), k.to_numpy(np.float64)
    good = (b >= 0) & (b <= a)
    a, b = np.where(good, a, 0.0), np.where(good, b, 0.0)
    return pd.Series(np.where(good, _log_gamma(a + 1) - _log_gamma(b + 1) - _log_gamma(a - b + 1), -np.inf))
