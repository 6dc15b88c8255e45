"""Symmetric Beta draws as Columns: the quantile function of Beta(a, a), 0 < a ≤ 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, STEPS = 64, 8


def series(a: float, terms: int = TERMS) -> list[float]:
    """Coefficients c_n of the distribution function x^a / B · Σ c_n x^n."""
    out, rising = [], 1.0  # rising: (1 − a)(2 − a)…(n − a) / n!
    for n in range(terms):
        out.append(rising / (a + n))
        rising *= (n + 1 - a) / (n + 1)
    return out


def total(a: float) -> float:
    """B(a, a)."""
    return math.gamma(a) ** 2 / math.gamma(2 * a)


def beta_quantile(u: Column, a: float) -> Column:
    """x with P(Beta(a, a) ≤ x) = u.

    a = 1/2 is the arcsine law. Otherwise the lower half is solved by Newton steps in t = x^a, in
    which the distribution function is a convex power series: from its leading term, an upper
    bound, the steps go down to the root. The upper half is the mirror image.
    """
    if not 0 < a <= 1:
        raise ValueError("the shape must be above 0 and at most 1")
    if a == 1:
        return u
    if a == 0.5:
        return F.pow(F.sin(u * F.lit(math.pi / 2)), 2)
    b, p = total(a), F.least(u, 1 - u)
    coefficients = F.array(*[F.lit(c) for c in reversed(series(a))])

    def step(t, _):
        x = F.pow(t, F.lit(1 / a))
        value = t / b * F.aggregate(coefficients, F.lit(0.0), lambda s, c: s * x + c)
        slope = F.pow(1 - x, F.lit(a - 1)) / F.lit(a * b)
        return t - (value - p) / slope
    t = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), p * F.lit(a * b), step)
    x = F.pow(t, F.lit(1 / a))
    return F.when(u <= 0.5, x).otherwise(1 - x)
