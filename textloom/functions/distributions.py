"""Tail probabilities of test statistics, for results of a few rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 10_000):
        b += 2
        d = 1 / ((b - i * (i - a) * d) or 1e-300)
        c = (b - i * (i - a) / c) or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@F.udf(T.DoubleType())
def _t(t, df):
    return None if t is None or df is None else 1.0 if t == 0 else beta_share(df / (df + t * t), df / 2, 0.5)


@F.udf(T.DoubleType())
def _f(f, d1, d2):
    return None if f is None or not d1 or not d2 else beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


@F.udf(T.DoubleType())
def _chi2(x, df):
    return None if x is None or not df else gamma_tail(df / 2, x / 2)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided probability of Student's t."""
    return _t(t.cast("double"), df.cast("double"))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    return _f(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution."""
    return _chi2(x.cast("double"), df.cast("double"))
