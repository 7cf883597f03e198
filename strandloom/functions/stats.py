"""Distribution functions as expressions, and critical values on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_even_sf(m: Column, x: Column) -> Column:
    """Upper tail of chi-squared with 2m degrees of freedom: a Poisson sum."""
    u = x / 2
    start = F.struct(F.exp(-u).alias("p"), F.exp(-u).alias("q"))
    return F.aggregate(
        F.when(m > 1, F.sequence(F.lit(1), (m - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        start,
        lambda s, i: F.struct((s["p"] * u / i).alias("p"), (s["q"] + s["p"] * u / i).alias("q")),
        lambda s: s["q"],
    )


def _erfc(x: Column) -> Column:
    """Complementary error function, to a relative error of about 1e-7: a rational exponent, by Horner's rule."""
    # fixed values: coefficients of a published Chebyshev fit
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly = F.lit(0.0)
    for c in reversed(fit):
        poly = poly * t + c
    y = t * F.exp(poly - z * z)
    return F.when(x >= 0, y).otherwise(2 - y)


def chi2_even_sf_any(m: Column, x: Column, exact: int = 256) -> Column:
    """The upper tail for any m: the Poisson sum up to ``exact``, above it the cube-root normal approximation."""
    k = 2.0 * m
    spread = 2.0 / (9.0 * k)
    z = (F.cbrt(x / k) - (1 - spread)) / F.sqrt(spread)
    return F.when(m <= exact, chi2_even_sf(F.least(m, F.lit(exact)), x)).otherwise(0.5 * _erfc(z / math.sqrt(2)))


def chi2_even_cdf(m: Column, x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - chi2_even_sf(m, x))


def label_score(kind: str, m: Column, sum_log: Column, sum_w: Column, max_w: Column) -> Column:
    """How strongly m edges into one label speak for it. sum_log is the sum of ln(1 - w)."""
    return {
        "fisher": lambda: chi2_even_cdf(m, -2 * sum_log),
        "tail": lambda: -chi2_even_sf(m, -2 * sum_log),
        "logsum": lambda: -sum_log,
        "sum": lambda: sum_w,
        "mean": lambda: sum_w / m,
        "max": lambda: max_w,
    }[kind]()


def _lower_gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = s = 1.0 / a
        n = a
        while abs(term) > abs(s) * 1e-16:
            n += 1
            term *= x / n
            s += term
        return s * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / max(an * d + b, tiny) if an * d + b > 0 else 1 / min(an * d + b, -tiny)
        c = b + an / c
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_critical(dof: int, alpha: float = 0.05, tests: int = 1) -> float:
    """The value that chi-squared exceeds with probability alpha / tests."""
    if dof < 1:
        return 0.0
    q = min(max(alpha / max(tests, 1), 1e-300), 1 - 1e-16)
    lo, hi = 0.0, max(10.0, 2.0 * dof)
    while 1 - _lower_gamma_share(dof / 2, hi / 2) > q and hi < 1e6:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - _lower_gamma_share(dof / 2, mid / 2) > q else (lo, mid)
    return (lo + hi) / 2


def t2(mean_a: Column, weight_a: Column, mean_b: Column, weight_b: Column) -> Column:
    """One sample's part of the distance between two groups, in units of its variance."""
    return (mean_a - mean_b) * (mean_a - mean_b) / (1 / weight_a + 1 / weight_b)
