"""Typed readers for the landed inputs (S1-S4, S12, S13) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.functions.columns import nan_to_null

FLOW = T.StructType([T.StructField("station_id", T.StringType()),
                     T.StructField("time", T.TimestampNTZType()),
                     T.StructField("flow_l_s", T.IntegerType()),
                     T.StructField("depth_mm", T.IntegerType()),
                     T.StructField("velocity_m_s", T.DoubleType())])
GAUGE_RAIN = T.StructType([T.StructField("gauge_id", T.StringType()),
                           T.StructField("time", T.TimestampNTZType()),
                           T.StructField("rain_mm_hr", T.DoubleType())])
READINGS = T.StructType([T.StructField("dateTime", T.TimestampNTZType()),
                         T.StructField("value", T.DoubleType()),
                         T.StructField("valueQualifier", T.StringType())])
FORECAST = T.StructType([T.StructField("time", T.TimestampNTZType()),
                         T.StructField("precipitation_surface", T.DoubleType()),
                         T.StructField("precipitation_surface_cum", T.DoubleType())])
MONITORS = T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("id", T.StringType()),
                         T.StructField("alt_id", T.StringType()),
                         T.StructField("site_name", T.StringType()),
                         T.StructField("pipe_diameter_mm", T.DoubleType()),
                         T.StructField("recently_active", T.StringType()),
                         T.StructField("lat", T.DoubleType()),
                         T.StructField("lon", T.DoubleType())])
CANDIDATES = T.StructType([T.StructField("chalk_station_index", T.LongType()),
                           T.StructField("chalk_station_id", T.StringType()),
                           T.StructField("chalk_station_name", T.StringType()),
                           T.StructField("station_id", T.StringType()),
                           T.StructField("is_flow", T.BooleanType()),
                           T.StructField("is_rainfall", T.BooleanType()),
                           T.StructField("is_groundwater", T.BooleanType()),
                           T.StructField("distance_m", T.DoubleType()),
                           T.StructField("upstream", T.BooleanType())])


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """Processed flow table; NaN measurements become NULL."""
    return _csv(spark, path, FLOW).withColumn("velocity_m_s", nan_to_null("velocity_m_s"))


def read_gauge_rain(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, GAUGE_RAIN).withColumn("rain_mm_hr", nan_to_null("rain_mm_hr"))


def read_readings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """S2 + P5: rain / groundwater readings, ``dateTime`` -> ``time``, ``value`` -> name;
    only time and value are kept (the qualifier must not enter the complete-row filter)."""
    r = _csv(spark, path, READINGS)
    return r.select(F.col("dateTime").alias("time"), nan_to_null("value").alias(name))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """S3: forecast point series."""
    return _csv(spark, path, FORECAST)


def read_monitors(spark: SparkSession, path: str, all_string: bool = False) -> DataFrame:
    """Monitor dimension, typed or all-string (for id cleaning)."""
    if all_string:
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in MONITORS.fields])
        return _csv(spark, path, schema)
    return _csv(spark, path, MONITORS)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, CANDIDATES)


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns that exist, ignore the others."""
    return df.drop(*[c for c in cols if c in df.columns])
