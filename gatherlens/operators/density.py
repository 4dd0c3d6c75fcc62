"""Hour-of-day densities.

A Gaussian kernel density over the hours of a topic's events, evaluated on an
evenly spaced grid, with Silverman's bandwidth factor divided by 0.6.  The input
is the hourly histogram, never the raw events: each density key holds at most 24
(hour, count) bins, so its bins fit in one array and the whole curve is computed
by higher-order functions on one row, with no join.

For n observations with hours h_i (counts c_h), sample standard deviation s
(ddof 1) and factor f = (3n/4)^(-1/5) / 0.6:

    y(x) = sum_h c_h * exp(-(x - h)^2 / (2 (f s)^2)) / (n * f s * sqrt(2 pi))

Keys with n < 2 or a single distinct hour have no defined bandwidth; their
densities are null.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.functions.scalars import linspace

# Fixed values of the reference's density view: grid 6..24 with 90 points,
# bandwidth factor divided by 0.6.
GRID_START, GRID_STOP, GRID_NUM = 6.0, 24.0, 90
BANDWIDTH_DIVISOR = 0.6


def hourly_density(hourly: DataFrame, grid_start: float = GRID_START,
                   grid_stop: float = GRID_STOP, grid_num: int = GRID_NUM,
                   divisor: float = BANDWIDTH_DIVISOR,
                   topics: list[str] | None = None) -> DataFrame:
    """Density curves from an hourly histogram (keys..., hour, n).

    Every column other than ``hour`` and ``n`` is a key (e.g. city, topic,
    day_type).  ``topics`` keeps only those topics (the histogram must then have
    a ``topic`` column).  Output: keys..., grid_i, x, density.
    """
    if topics is not None:
        hourly = hourly.filter(F.col("topic").isin(list(topics)))
    keys = [c for c in hourly.columns if c not in ("hour", "n")]
    bins = (hourly.groupBy(*keys, "hour").agg(F.sum("n").alias("c"))
                  .groupBy(*keys)
                  .agg(F.sum("c").cast("double").alias("n_obs"),
                       F.collect_list(F.struct(F.col("hour").cast("double").alias("h"),
                                               F.col("c").cast("double").alias("c")))
                        .alias("bins")))
    zero = F.lit(0.0)
    mean = F.aggregate("bins", zero, lambda acc, b: acc + b["c"] * b["h"]) / F.col("n_obs")
    bins = bins.withColumn("mean", mean)
    var = F.aggregate("bins", zero,
                      lambda acc, b: acc + b["c"] * (b["h"] - F.col("mean")) ** 2) \
        / (F.col("n_obs") - 1)
    factor = F.pow(F.col("n_obs") * 0.75, -0.2) / divisor
    bw = F.when((F.col("n_obs") >= 2) & (var > 0), factor * F.sqrt(var))
    bins = bins.withColumn("bw", bw)
    norm = F.col("n_obs") * F.col("bw") * math.sqrt(2 * math.pi)

    def curve_at(x):
        s = F.aggregate("bins", zero,
                        lambda acc, b: acc + b["c"] * F.exp(-0.5 * ((x - b["h"]) / F.col("bw")) ** 2))
        return s / norm

    curve = F.transform(linspace(grid_start, grid_stop, grid_num),
                        lambda x: F.struct(x.alias("x"), curve_at(x).alias("density")))
    return (bins.select(*keys, F.posexplode(curve).alias("grid_i", "pt"))
                .select(*keys, "grid_i", F.col("pt.x").alias("x"),
                        F.col("pt.density").alias("density")))


def best_hour(density: DataFrame) -> DataFrame:
    """K2: per key, the grid point with the highest density and that density."""
    keys = [c for c in density.columns if c not in ("grid_i", "x", "density")]
    return density.groupBy(*keys).agg(F.max_by("x", "density").alias("peak_x"),
                                      F.max("density").alias("peak_density"))
