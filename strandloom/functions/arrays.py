"""Small vectors as arrays: ranks, unit vectors, dot products. All are JVM-side expressions over short arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_ranks(v: Column) -> Column:
    """Ranks from 1; equal values share the mean of their ranks."""
    return F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / F.lit(2.0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def centred_unit(v: Column) -> Column:
    """Minus the mean, over the length; all zeros if there is no variation."""
    mean = total(v) / F.size(v)
    c = F.transform(v, lambda x: x - mean)
    return unit(c)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; zero if there is nothing to compare."""
    low = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    high = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(high > 0, low / high).otherwise(F.lit(0.0))


def depth_term(corr: Column, wjac: Column, mode: str = "corr", neg_corr: float = -0.3) -> Column:
    """The depth part of an edge's weight; null where strongly opposed profiles cut the edge."""
    cp = F.greatest(corr, F.lit(0.0))
    wj = F.least(F.greatest(wjac, F.lit(0.0)), F.lit(1.0))
    value = {"corr": cp, "wjac": wj, "min": F.least(cp, wj), "product": cp * wj, "geomean": F.sqrt(cp * wj)}[mode]
    return F.when(corr < neg_corr, F.lit(None).cast("double")).otherwise(value)
