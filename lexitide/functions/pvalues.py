"""p-values as columns: log-gamma and the regularised incomplete beta function by built-in functions, so no row goes to Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed coefficients of Lanczos' approximation (g = 7, nine terms).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TERMS = 250


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 0.5."""
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _half_step(a: Column) -> Column:
    """ln gamma(a + 1/2) - ln gamma(a): by its series for large a, where the difference of two large logarithms would lose digits."""
    series = 0.5 * F.ln(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)
    return F.when(a > 40, series).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its end: TERMS terms and no state but a number."""

    def term(rest: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / rest)

    down = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    inner = F.aggregate(down, F.lit(1.0), term)
    return 1 / (1 - (a + b) * x / (a + 1) / inner)


def t_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t; null for null or non-finite t and for dof of 0 and less."""
    t, dof = t.cast("double"), dof.cast("double")
    a, square = dof / 2, t * t
    x, rest = dof / (dof + square), square / (dof + square)
    # x^a (1 - x)^(1/2) / (a B(a, 1/2)), with ln x by log1p as x is near 1 for small t
    front = F.exp(_half_step(a) - 0.5 * math.log(math.pi) - a * F.log1p(square / dof) + 0.5 * F.ln(F.nullif(rest, F.lit(0.0))))
    half = F.lit(0.5)
    low = front * _fraction(a, half, x) / a
    high = 1 - front * _fraction(half, a, rest) / half
    fine = (dof > 0) & (F.abs(t) < float("inf"))
    return F.when(fine & (square == 0), 1.0).when(fine, F.when(x < (a + 1) / (a + 2.5), low).otherwise(high))


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; 0 for a perfect one, null for fewer than three pairs."""
    r, n = r.cast("double"), n.cast("double")
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(t_p(t, n - 2)))
