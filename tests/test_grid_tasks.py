"""Tasks of a regular grid keep their size when the grid grows."""

from pyspark.sql import functions as F

from flowrisk.operators.grid import regular_grid
from flowrisk.operators.halo import HaloSpec
from flowrisk.session import ROWS_PER_TASK


def test_grid_rows_of_one_task(spark):
    """10 million grid rows from two observations of each of 2,000 keys."""
    ends = spark.range(4000).select((F.col("id") % 2000).alias("k"), (F.col("id") >= 2000).cast("int").alias("end"))
    obs = ends.select("k", F.timestamp_seconds(F.col("end") * 4999 * 60).alias("t"), F.lit(1.0).alias("v"))
    lay = regular_grid(obs, "k", "t", 60, HaloSpec())
    assert lay.count() == 10_000_000
    largest = lay.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert largest <= 1.5 * ROWS_PER_TASK
