"""Distribution tails that have no finite column form, for small result tables (Arrow UDFs)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Studentised range quantiles / sqrt(2) at 5 %, for 2 .. 10 groups and many blocks (fixed values, Demsar's table).
NEMENYI_Q = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * out


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_quantile(df: float, two_sided: float = 0.05) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf2(mid, df) > two_sided else (lo, mid)
    return (lo + hi) / 2


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _each(fn, *cols):
    return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*cols)], dtype="float64")


def _column(fn, *cols):
    """Applies fn to a few result rows; made on the driver only, as workers import this module too."""

    def one(a: pd.Series) -> pd.Series:
        return _each(fn, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(fn, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _each(fn, a, b, c)

    return F.pandas_udf((one, two, three)[len(cols) - 1], "double")(*cols)


def t_p(t, df):
    """Two-sided p of t."""
    return _column(lambda a, b: t_sf2(a, b) if b > 0 else None, t, df)


def t_crit(df):
    """95 % quantile of t, two-sided."""
    return _column(lambda b: t_quantile(b) if b > 0 else None, df)


def chi2_p(x, df):
    """Upper tail of chi squared."""
    return _column(lambda a, b: gammaincc(b / 2, a / 2) if b > 0 else None, x, df)


def u_exact(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties: the coefficients of the Gaussian binomial count the arrangements of each U."""
    n, m = sorted((int(n), int(m)))
    count = np.array([1] + [0] * (n * m), dtype=object)
    for i in range(1, n + 1):
        shifted = count.copy()
        shifted[m + i :] -= count[: max(len(count) - m - i, 0)]  # times 1 - x^(m + i)
        for k in range(i):  # divided by 1 - x^i
            shifted[k::i] = np.cumsum(shifted[k::i])
        count = shifted
    return min(1.0, 2 * int(count[math.ceil(max(u, n * m - u)) :].sum()) / math.comb(n + m, n))


def mann_whitney_p(u, n, m, least: int = 8):
    """Exact two-sided p of U where a group has at most `least` values; null elsewhere."""
    return _column(lambda a, b, c: u_exact(a, b, c) if 0 < min(b, c) <= least else None, u, n, m)


def shapiro_w(x: np.ndarray) -> tuple[float, float]:
    """Royston's approximation of the Shapiro-Wilk statistic and its p for 4 to 5000 values."""
    x, n = np.sort(x), len(x)
    if n < 4 or x[0] == x[-1]:
        return float("nan"), float("nan")
    inv = lambda p: math.sqrt(2) * _erfinv(2 * p - 1)
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = (m * m).sum(), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    a[-1] += np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    if n > 5:
        a[-2] += np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        k = 2
    else:
        phi, k = (mm - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2), 1
    a[k:-k] = m[k:-k] / math.sqrt(phi)
    a[:k] = -a[-k:][::-1]
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n <= 11:
        g, mu, s = -2.273 + 0.459 * n, 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-math.log(max(g - math.log(max(1 - w, 1e-300)), 1e-300)) - mu) / s
    else:
        ln = math.log(n)
        mu, s = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3, math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
        z = (math.log(max(1 - w, 1e-300)) - mu) / s
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def _erfinv(y: float) -> float:
    lo, hi = -6.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return (lo + hi) / 2
