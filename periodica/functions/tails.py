"""Tail probabilities for small result tables.

Spark SQL has no error function and no incomplete beta or gamma function. These pandas
UDFs only ever see one row per tested pair, after the data has been aggregated.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Send these functions along with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Degrees of freedom from which the limits for large numbers are used.
NORMAL_FROM = 1e5


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            return front * total / a
    raise ArithmeticError(f"incomplete beta of {a}, {b} at {x} does not converge")


def student_two_sided(t: float, df: float) -> float:
    if df is None or t is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > NORMAL_FROM:  # the normal limit with its first corrections; the error is of order 1 / df ** 2
        return normal_two_sided(t * (1.0 - 0.25 / df) / math.sqrt(1.0 + t * t / (2.0 * df)))
    return beta_tail(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.nan if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: series below the mean, continued fraction above."""
    if x is None or math.isnan(x) or df is None or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    if df > NORMAL_FROM:  # the cube root is nearly normal (Wilson and Hilferty)
        z = ((x / df) ** (1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / math.sqrt(2.0 / (9.0 * df))
        return 0.5 * math.erfc(z / math.sqrt(2.0))
    a, h = df / 2.0, x / 2.0
    front = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= h / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = h + 1.0 - a
    c, d = 1e300, 1.0 / b
    total = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * total
    raise ArithmeticError(f"chi-square tail of {x} with {df} degrees of freedom does not converge")


def u_counts(n1: int, n2: int) -> list[int]:
    """How many of the ways to mix two samples without equal values give each U, from 0 to n1 n2.

    The counts are the coefficients of the product of (1 - q^(n2 + i)) / (1 - q^i) for i = 1 .. n1.
    """
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(n1 * n2, n2 + i - 1, -1):
            counts[u] -= counts[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            counts[u] += counts[u - i]
    return counts


def u_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact probability of a U at least as far from its mean."""
    low, high = sorted((int(n1), int(n2)))
    counts = u_counts(low, high)
    return min(1.0, 2 * sum(counts[int(max(u, n1 * n2 - u)):]) / sum(counts))


@F.pandas_udf(DoubleType())
def u_exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """For small samples only; others give NaN and cost nothing."""
    small = (n1 + n2 <= 400) & (n1.clip(upper=n2) <= 8) & (u % 1 == 0)
    return pd.Series([u_exact(a, b, c) if s else math.nan for a, b, c, s in zip(u, n1, n2, small)])


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float))])


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(v) for v in z.astype(float)])


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, b) for a, b in zip(x.astype(float), df.astype(float))])
