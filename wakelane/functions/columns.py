"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding so that exact ties do not hang on the order of a sum.
OFF_TIE = 3.7e-9


def shown(c, digits: int = 6) -> Column:
    """Rounds a double for comparison across engines."""
    return F.round(F.col(c) + OFF_TIE if isinstance(c, str) else c + OFF_TIE, digits)


def hash_uniform(seed: int | Column, *keys) -> Column:
    """Uniform in [0, 1) from md5 of the seed and keys; the same in SQL."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed
    digest = F.md5(F.concat_ws(":", seed, *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_order(seed: int, *keys) -> Column:
    """A pseudo-random order, reproducible across runs and engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(otherwise))


def normal_cdf(z: Column) -> Column:
    """Rational approximation of the normal distribution function, error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def chi2_sf_even(x: Column, half_df: int) -> Column:
    """Upper tail of chi-squared with 2 * half_df degrees of freedom, by its finite sum."""
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, half_df):
        term = term * (x / 2) / k
        total = total + term
    return F.exp(-x / 2) * total
