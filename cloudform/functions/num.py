"""Null-safe numbers: missing is NULL and never NaN, division by nothing is NULL."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-12


def known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b)


def share(a: Column, b: Column) -> Column:
    """0.0 where the denominator is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def skew(x: str) -> Column:
    """Bias-adjusted skewness; NULL under three values or without spread."""
    n = F.count(x)
    g = F.when(F.stddev_pop(x) > EPS, F.skewness(x))
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def trend(delta: Column, stable: float = 0.25) -> Column:
    return F.when(delta.isNull(), "unknown").when(F.abs(delta) < stable, "stable").when(delta > 0, "increase").otherwise("decrease")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient of an aggregation; NULL without spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > EPS) & (sy > EPS), F.covar_pop(x, y) / (sx * sy))


def mean_rank(value: str, *keys: str) -> Column:
    """Average rank of ties within keys."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def robust(x: Column, q: Column) -> Column:
    """(x - median) / IQR from q = percentile(0.25, 0.5, 0.75); NULL without spread."""
    return ratio(x - q[1], q[2] - q[0])
