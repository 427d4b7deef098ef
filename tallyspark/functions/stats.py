"""Normal and chi-square probabilities as Column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational Chebyshev fit of erfc (Numerical Recipes).
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC[-1])
    for coefficient in reversed(ERFC[:-1]):
        poly = F.lit(coefficient) + t * poly
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


# Zelen & Severo 26.2.17 polynomial for the normal upper tail.
TAIL_STEP, TAIL_HEIGHT = 0.2316419, 0.3989422804014327
TAIL = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(TAIL_STEP) * z)
    poly = F.lit(TAIL[-1])
    for coefficient in reversed(TAIL[:-1]):
        poly = F.lit(coefficient) + t * poly
    return F.lit(TAIL_HEIGHT) * F.exp(-z * z / F.lit(2.0)) * t * poly


def normal_cdf(z: Column) -> Column:
    return F.when(z > 0, F.lit(1.0) - _upper_tail(F.abs(z))).otherwise(_upper_tail(F.abs(z)))


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * _upper_tail(F.abs(z)))


def chi_square_1_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return F.when(x > 0, erfc(F.sqrt(x / F.lit(2.0)))).otherwise(F.lit(1.0))


def normal_quantile(p: float) -> float:
    """Quantile for a fixed level; used as a literal."""
    return NormalDist().inv_cdf(p)
