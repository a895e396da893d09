"""Densities of points in the plane as rows of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(points: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, size: int) -> DataFrame:
    """Share of each group's points by cell of a size x size grid; points outside count at the edge."""
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((F.col(v) - low) / (high - low) * size))).cast("int")
    out = points.groupBy(*keys, at(x).alias("ix"), at(y).alias("iy")).agg(F.count("*").alias("n"))
    return out.withColumn("mass", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def smoothed(grid: DataFrame, keys: list[str], size: int, sigma: float, reach: float = 4.0) -> DataFrame:
    """The grid under a Gaussian kernel, reflected at the edges; separable, so one join with offsets for each axis."""
    r = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v / sum(w)).alias("w")) for k, v in zip(range(-r, r + 1), w, strict=True)))
    for axis in ("ix", "iy"):
        t = F.pmod(F.col(axis) + F.col("tap.k"), F.lit(2 * size))
        grid = grid.withColumn("tap", F.explode(taps)).withColumn(axis, F.when(t < size, t).otherwise(2 * size - 1 - t)).groupBy(*keys, "ix", "iy").agg(F.sum(F.col("mass") * F.col("tap.w")).alias("mass"))
    return grid


def concentration(grid: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Entropy, highest mass, and the smallest number of cells with half and with nine tenths of the mass."""
    w = Window.partitionBy(*keys).orderBy(F.col("mass").desc(), "ix", "iy")
    run = grid.withColumns({"run": F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, -1)), "m": F.col("mass")})
    before = F.coalesce("run", F.lit(0.0))
    return run.groupBy(*keys).agg((F.sum(-F.col("m") * F.ln("m")) / math.log(size * size)).alias("entropy"), F.max("m").alias("peak"), F.count_if(before < 0.5 - 1e-9).alias("cells_50"), F.count_if(before < 0.9 - 1e-9).alias("cells_90"))


def gated_cells(points: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, size: int, least: int) -> DataFrame:
    """cells of the groups with at least `least` points."""
    n = points.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return cells(points.join(n.select(*keys), keys, "left_semi"), keys, x, y, low, high, size)


def mass_ceiling(grid: DataFrame, keys: list[str], share: float = 0.995) -> DataFrame:
    """The percentile of the masses of the cells that hold any, for a common scale."""
    return grid.where("mass > 0").groupBy(*keys).agg(F.percentile("mass", F.lit(share)).alias("ceiling"))


def entropy_trend(points: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, size: int) -> DataFrame:
    """Slope by year and R² of the entropy of each year's cells."""
    by_year = concentration(cells(points, [*keys, "year"], x, y, low, high, size), [*keys, "year"], size)
    two = F.count("*") > 1
    return by_year.groupBy(*keys).agg(F.when(two, F.regr_slope("entropy", "year")).alias("entropy_slope"), F.when(two, F.regr_r2("entropy", "year")).alias("entropy_r2"))


def kernel_cells(points: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, size: int, *, most: int | None = None, sigma: float = 2.0) -> DataFrame:
    """Masses by cell under a Gaussian kernel with each group's covariance (Scott's width), at the centres of the cells.

    Each point adds to all size² cells, summed by task before the shuffle. Where `most` is given, groups of more points get
    their smoothed cells instead, as do groups without a covariance.
    """
    n = points.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"))
    det = F.col("a") * F.col("b") - F.col("c") * F.col("c")
    few = n.where((F.lit(True) if most is None else F.col("n") <= most) & (F.col("n") > 2) & (det > 1e-12)).withColumns({"f": F.pow("n", F.lit(1 / 3)), "det": det})  # n^(-1/6), squared and inverted
    step = (high - low) / size
    at = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    spots = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).join(few, keys)
    spots = spots.withColumn("ix", at).withColumn("iy", at).withColumns({"dx": low + (F.col("ix") + 0.5) * step - F.col("_x"), "dy": low + (F.col("iy") + 0.5) * step - F.col("_y")})
    q = (F.col("b") * F.col("dx") * F.col("dx") - 2 * F.col("c") * F.col("dx") * F.col("dy") + F.col("a") * F.col("dy") * F.col("dy")) / F.col("det") * F.col("f")
    sums = spots.groupBy(*keys, "ix", "iy").agg(F.sum(F.exp(-q / 2)).alias("w"))
    kernel = sums.withColumn("mass", F.col("w") / F.sum("w").over(Window.partitionBy(*keys))).drop("w")
    rest = points.join(few.select(*keys), keys, "left_anti")
    return kernel.unionByName(smoothed(cells(rest, keys, x, y, low, high, size), keys, size, sigma))
