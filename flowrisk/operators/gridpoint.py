"""Forecast cube -> point series.

J11: for each requested point the nearest latitude and the nearest longitude are
chosen independently among the cube's distinct axis values: the axis values next below
and next above a point are found by windows over coordinate buckets, so no all-pairs
product is formed; ties go to the smaller coordinate.
A1: z-score with the series mean and sample standard deviation; W16: cumulative sum
in time order (carried across time buckets by ``compute_features``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions.columns import attach_scalars, safe_div


def nearest_axis(points: DataFrame, axis_values: DataFrame, coord: str, out: str,
                 bucket_width: float = 1.0) -> DataFrame:
    """Nearest ``axis_values.value`` to ``points[coord]`` (per point id column ``point``).

    Points and axis values are laid out together by coordinate bucket.  The axis values
    just below and just above a point come from windows within its bucket, or, where the
    bucket has none on that side, from the nearest bucket that does (last / first value
    carried over the small table of buckets).  So any spacing of the axis works, and a
    point beyond its ends gets the end.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(bucket_width)).cast("long")
    none = F.lit(None)
    ax = axis_values.select(F.col("value").cast("double").alias("_ax")).distinct()
    u = (points.select("point", F.col(coord).cast("double").alias("_x"), none.cast("double").alias("_ax"))
         .unionByName(ax.select(none.cast(points.schema["point"].dataType).alias("point"),
                                F.col("_ax").alias("_x"), "_ax")).withColumn("_b", b("_x")))
    ends = u.groupBy("_b").agg(F.min("_ax").alias("_first"), F.max("_ax").alias("_last"))
    line = Window.orderBy("_b")                                   # one row per bucket
    ends = ends.select(
        "_b", F.last("_last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inb = Window.partitionBy("_b").orderBy("_x")
    near = u.select("*", F.last("_ax", True).over(inb.rangeBetween(Window.unboundedPreceding, 0)).alias("_lo"),
                    F.first("_ax", True).over(inb.rangeBetween(0, Window.unboundedFollowing)).alias("_hi"))
    near = near.where(F.col("point").isNotNull()).join(ends, "_b")
    lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    pick = F.when(hi.isNull() | (F.col("_x") - lo <= hi - F.col("_x")), lo).otherwise(hi)
    return near.select("point", pick.alias(out)).where(F.col(out).isNotNull())


def point_series(cube: DataFrame, points: DataFrame, bucket_width: float = 1.0) -> DataFrame:
    """Cube (time, latitude, longitude, value) x points (point, lat, lon) ->
    (point, time, value) at the nearest grid cell of each point."""
    lat = nearest_axis(points, cube.select(F.col("latitude").alias("value")), "lat",
                       "latitude", bucket_width)
    lon = nearest_axis(points, cube.select(F.col("longitude").alias("value")), "lon",
                       "longitude", bucket_width)
    cells = lat.join(lon, "point")
    return cube.join(cells, ["latitude", "longitude"]).select("point", "time", "latitude",
                                                               "longitude", "value")


def zscore(df: DataFrame, value: str, keys=(), name: str = "z") -> DataFrame:
    """A1: ``(x - mean) / std_samp`` with per-key (or global) statistics."""
    keys = list(keys)
    if keys:
        st = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
        d = df.join(st, keys)
    else:
        d = attach_scalars(df, df.agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd")))
    return d.withColumn(name, safe_div(F.col(value) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")
