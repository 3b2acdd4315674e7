"""Forecast cube -> point series on driver tables.

cube <- ``orders`` x ``customer``: daily order value (in millions) on a grid of
latitude ``50 + 0.25 * nation`` and longitude ``-2 + 0.5 * floor(balance / 1000)``;
points <- ``nation``: ``(50.1 + 0.23 * nation, -1.9 + 0.61 * region)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import rnd
from flowrisk.operators.gridpoint import nearest_axis, point_series, zscore
from flowrisk.operators.grid import regular_grid
from flowrisk.operators.halo import HaloSpec
from flowrisk.operators.windows import Feat, compute_features
from flowrisk.sources.tables import table


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("o_orderdate").alias("time"),
                     (50.0 + F.col("c_nationkey") * 0.25).alias("latitude"),
                     (-2.0 + F.floor(F.col("c_acctbal") / 1000) * 0.5).alias("longitude")) \
            .agg((F.sum(F.round(F.col("o_totalprice") * 100)) / 1e8).alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("point"),
                    (50.1 + F.col("n_nationkey") * 0.23).alias("lat"),
                    (-1.9 + F.col("n_regionkey") * 0.61).alias("lon"))


def gridpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = point_series(cube(spark, sf_dir), points(spark, sf_dir))
    z = zscore(s, "value", keys=["point"], name="z")
    lay = regular_grid(z.select("point", "time", "latitude", "longitude", "value", "z"),
                       "point", "time", 86400, HaloSpec().fitted())
    cum = compute_features(lay, "point", [Feat("z_cum", "cumsum", "z")], 24.0)
    cum = cum.where(F.col("value").isNotNull())
    return cum.groupBy("point").agg(
        F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"),
        F.count(F.lit(1)).alias("n_days"), rnd(F.sum("value"), 6).alias("value_sum"),
        rnd(F.max("z_cum"), 6).alias("max_cum"), rnd(F.min("z_cum"), 6).alias("min_cum"))


def sparse_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 on coarse, uneven axes with points between and beyond them: suppliers are the
    points, latitudes and longitudes come from nations (squares and cubes)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    axes = n.select((F.col("k") * F.col("k") * 2.5 - 300).alias("latitude"),
                    (F.col("k") * F.col("k") * F.col("k") / 4.0).alias("longitude"))
    p = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("point"), (F.col("s_acctbal") / 4).alias("lat"),
        (F.col("s_acctbal") * 0.7 - 1000).alias("lon"))
    lat = nearest_axis(p, axes.select(F.col("latitude").alias("value")), "lat", "latitude")
    lon = nearest_axis(p, axes.select(F.col("longitude").alias("value")), "lon", "longitude")
    return lat.join(lon, "point").select(F.col("point").cast("long").alias("point"), "latitude", "longitude")


SPARSE_AXES_SQL = """
WITH ax AS (SELECT CAST(n_nationkey AS BIGINT) * n_nationkey * 2.5 - 300 AS la,
                   CAST(n_nationkey AS BIGINT) * n_nationkey * n_nationkey / 4.0 AS lo FROM nation),
p AS (SELECT CAST(s_suppkey AS BIGINT) AS point, s_acctbal / 4 AS x, s_acctbal * 0.7 - 1000 AS y FROM supplier)
SELECT point, CAST(arg_min(la, (abs(la - x), la)) AS DOUBLE) AS latitude,
       CAST(arg_min(lo, (abs(lo - y), lo)) AS DOUBLE) AS longitude
FROM p, ax GROUP BY point
"""

GRIDPOINT_SQL = """
WITH cube AS (
  SELECT o.o_orderdate AS time, 50.0 + c.c_nationkey * 0.25 AS latitude,
         -2.0 + floor(c.c_acctbal / 1000) * 0.5 AS longitude,
         sum(round(o.o_totalprice * 100)) / 1e8 AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3),
pts AS (SELECT n_nationkey AS point, 50.1 + n_nationkey * 0.23 AS lat, -1.9 + n_regionkey * 0.61 AS lon
        FROM nation),
la AS (SELECT p.point, arg_min(a.latitude, (abs(a.latitude - p.lat), a.latitude)) AS latitude
       FROM pts p, (SELECT DISTINCT latitude FROM cube) a GROUP BY p.point),
lo AS (SELECT p.point, arg_min(a.longitude, (abs(a.longitude - p.lon), a.longitude)) AS longitude
       FROM pts p, (SELECT DISTINCT longitude FROM cube) a GROUP BY p.point),
s AS (SELECT la.point, cube.time, cube.latitude, cube.longitude, cube.value
      FROM la JOIN lo USING (point) JOIN cube ON cube.latitude = la.latitude
      AND cube.longitude = lo.longitude),
z AS (SELECT *, (value - avg(value) OVER (PARTITION BY point))
                / stddev_samp(value) OVER (PARTITION BY point) AS z FROM s),
c AS (SELECT *, sum(z) OVER (PARTITION BY point ORDER BY time
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z_cum FROM z)
SELECT point, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
       count(*) AS n_days, round(sum(value), 6) AS value_sum, round(max(z_cum), 6) AS max_cum,
       round(min(z_cum), 6) AS min_cum
FROM c GROUP BY point
"""
