"""Exact tests that need more than a closed form; Arrow batches, one row at a time inside numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _two_sided(k: int, n: int, p: float) -> float:
    """Sum of the chances of all outcomes no likelier than k, of n trials at p."""
    if n <= 0 or p <= 0 or p >= 1:
        return 1.0 if n <= 0 or k == (n if p >= 1 else 0) else 0.0
    steps = np.log(np.arange(n, 0, -1)) - np.log(np.arange(1, n + 1)) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate(([0.0], np.cumsum(steps)))
    return float(min(1.0, np.exp(logs[logs <= logs[k] + 1e-7]).sum()))


@F.pandas_udf(DoubleType())
def _binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else _two_sided(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def binomial_p(k: str, n: str, p: str) -> Column:
    """Two-sided p-value of k successes of n against the chance p; the work of a row grows with n."""
    return _binomial(F.col(k), F.col(n), F.col(p))


def _gamma_tail(a: float, x: float) -> float:
    """Share of the gamma distribution of shape a above x: by its series below the mean, by a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    return scale * _fraction(x + 1 - a, lambda i: -i * (i - a), lambda i: x + 1 - a + 2 * i)


def _beta_share(x: float, a: float, b: float) -> float:
    """Share of the beta distribution (a, b) below x, by its continued fraction on the side where that is fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def part(i: int) -> float:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    return scale * _fraction(1.0, part, lambda i: 1.0)


def _fraction(first: float, part, rest, tiny: float = 1e-300) -> float:
    """1 / (first + part(1) / (rest(1) + part(2) / (rest(2) + ...))) by Lentz's method."""
    d = 1 / (first or tiny)
    c, value = 1 / tiny, d
    for i in range(1, 100_000):
        d = 1 / (rest(i) + part(i) * d or tiny)
        c = rest(i) + part(i) / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def _rows(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*map(float, row)) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(lambda v, k: _gamma_tail(k / 2, v / 2) if k > 0 else None, x, df)


@F.pandas_udf(DoubleType())
def _f(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rows(lambda v, a, b: (_beta_share(b / (b + a * v), b / 2, a / 2) if v > 0 else 1.0) if a > 0 and b > 0 else None, x, d1, d2)


def chi2_p(x: Column, df: Column) -> Column:
    """P(chi-squared with df degrees of freedom > x); null without a degree of freedom."""
    return _chi2(x, df)


def f_p(x: Column, d1: Column, d2: Column) -> Column:
    """P(F with d1 and d2 degrees of freedom > x); null without degrees of freedom."""
    return _f(x, d1, d2)
