"""Tasks keep their size when a table grows: more rows make more tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowrisk.operators import cv
from flowrisk.plans import selection
from flowrisk.session import ROWS_PER_TASK


def _largest(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_ordered_lines_of_one_task(spark, tmp_path):
    n = 8_000_000
    i = F.col("id")
    spark.range(n).select(
        i.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.timestamp_seconds(i % 2000 * 86400).alias("l_shipdate"),
        *[(i % 7 + 1).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = selection._ordered_lineitem(spark, str(tmp_path))
    assert _largest(lines) <= 1.5 * ROWS_PER_TASK
    whole = lines.agg(F.count("*"), F.min("row_idx"), F.max("row_idx"), F.sum("row_idx"), F.max("n_rows")).first()
    assert tuple(whole) == (n, 0, n - 1, n * (n - 1) // 2, n)


def test_ordinal_with_outer_buckets(spark):
    """Per key, and over all rows, the same positions as one window over everything."""
    d = spark.range(500).select((F.col("id") % 3).alias("k"), (F.xxhash64("id") % 1000).alias("a"), F.col("id").alias("b"))
    inner = F.struct(F.floor(F.col("a") / 100).alias("x"), F.floor(F.col("a") / 10).alias("y"))
    d = d.withColumn("o", F.struct("a", "b"))
    for keys in ([], ["k"]):
        got = cv.ordinal(d, keys, "o", inner, outer=F.floor(F.col("a") / 100))
        assert set(got.columns) == {*d.columns, "row_idx", "n_rows"}
        w = Window.partitionBy(*keys)
        bad = got.withColumn("at", F.row_number().over(w.orderBy("o")) - 1).withColumn("n", F.count("*").over(w))
        assert bad.count() == 500
        assert bad.where("at <> row_idx or n <> n_rows").count() == 0


def test_rows_of_one_fitting_task(spark, monkeypatch):
    """The regressor gets its rows in small tasks, in the order of their positions."""
    from flowrisk import session
    from flowrisk.operators import models as ml
    seen = []
    monkeypatch.setattr(session, "ROWS_PER_TASK", 5000)
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, df: seen.append(df))
    d = spark.range(100_000).select(F.col("id").alias("row_idx"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    ml.fit_regressor(d, ["x"], "y", order="row_idx")
    at = seen[0].select(F.spark_partition_id().alias("p"), "row_idx").collect()
    tasks = {}
    for r in at:
        tasks.setdefault(r["p"], []).append(r["row_idx"])
    assert len(at) == 100_000 and max(map(len, tasks.values())) <= 4 * 4096
    assert len(tasks) > 8 and all(t == sorted(t) for t in tasks.values())
