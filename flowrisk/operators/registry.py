"""Registry of fitted fold models in a shared folder.

One run per horizon: its fold models (MLlib persistence), the folds each key can use, the
kept features and the conformal thresholds; last of all the run's rows in the manifest, which
is the commit marker: what is not in the manifest counts as not run, whatever else is there.
Scoring loads the models back and runs one ``transform`` per model, over the rows of the
keys that chose the ensemble and can use that fold.

``root`` is a folder that all executors share, such as one in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.operators import models as ml
from flowrisk.sources import sinks

MANIFEST = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("horizon_hours", T.IntegerType())])
#: The other tables' columns: a table that no run had rows for has no file to infer them from.
FOLDS = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("fold", T.IntegerType()),
                      T.StructField("usable", T.BooleanType()), T.StructField("horizon_hours", T.IntegerType())])
FEATURES = T.StructType([T.StructField("feature", T.StringType()), T.StructField("rank", T.IntegerType()),
                         T.StructField("horizon_hours", T.IntegerType())])
CONFORMAL = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("conf_threshold", T.DoubleType()),
                          T.StructField("horizon_hours", T.IntegerType())])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    if not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def finished(spark: SparkSession, root: str) -> DataFrame:
    """The (station, horizon) pairs whose run is committed."""
    return _read(spark, root, "manifest", MANIFEST)


def stored_folds(spark: SparkSession, root: str) -> DataFrame:
    """Every stored (station, horizon, fold) and whether it is usable."""
    return _read(spark, root, "folds", FOLDS)


def stored_thresholds(spark: SparkSession, root: str) -> DataFrame:
    """Conformal thresholds per (station, horizon); none where no fold was usable."""
    return _read(spark, root, "conformal", CONFORMAL)


def save_run(root: str, horizon: int, models: dict, weights: DataFrame, key: str, features: DataFrame,
             thresholds: DataFrame, stations: DataFrame) -> None:
    """S15 + S16: everything that scoring one horizon needs; its rows of the manifest last.

    ``weights`` are ``models.fold_weights``; ``features`` has (feature, rank), ``thresholds``
    (key, conf_threshold), ``stations`` the keys that the run covers.
    """
    h = F.lit(int(horizon)).alias("horizon_hours")
    sinks.save_models(models, f"{root}/models/horizon={int(horizon)}")
    sinks.write_partitions(weights.select(F.col(key).alias("station_id"), "fold", "usable", h), f"{root}/folds",
                           ["horizon_hours"])
    sinks.write_partitions(features.select("feature", "rank", h), f"{root}/features", ["horizon_hours"])
    sinks.write_partitions(thresholds.select(F.col(key).alias("station_id"), "conf_threshold", h), f"{root}/conformal",
                           ["horizon_hours"])
    sinks.write_partitions(stations.select(F.col(key).alias("station_id"), h), f"{root}/manifest", ["horizon_hours"])


def load_models(spark: SparkSession, root: str, horizon: int) -> dict[int, GBTClassificationModel]:
    """{fold: model} of one horizon, from the folds that its run could use."""
    folds = stored_folds(spark, root).where((F.col("horizon_hours") == int(horizon)) & F.col("usable"))
    used = sorted(r["fold"] for r in folds.select("fold").distinct().collect())      # at most the folds
    return {f: GBTClassificationModel.load(f"{root}/models/horizon={int(horizon)}/fold={f}") for f in used}


def kept_features(spark: SparkSession, root: str, horizon: int) -> list[str]:
    kept = _read(spark, root, "features", FEATURES).where(F.col("horizon_hours") == int(horizon))
    return [r["feature"] for r in kept.orderBy("rank").select("feature").collect()]  # at most the features


def score(rows: DataFrame, root: str, horizon: int, key: str, row_keys: Sequence[str],
          extra: Sequence[str] = (), chosen: DataFrame | None = None) -> DataFrame:
    """Mean probability of the reloaded fold models, ``p_ens`` and ``n_models`` per row.

    ``chosen`` (key column only) names the keys that use the models; all keys without it.  Rows
    of other keys, and of keys without a usable fold, are not scored and have no row.
    """
    spark = rows.sparkSession
    folds = stored_folds(spark, root).where(F.col("horizon_hours") == int(horizon))
    folds = folds.select(F.col("station_id").alias(key), "fold", "usable", F.lit(1.0).alias("weight"))
    if chosen is not None:
        rows = rows.join(chosen.select(key).distinct(), key, "left_semi")
    feats = [*kept_features(spark, root, horizon), *extra]
    return ml.ensemble_predict(rows, folds, load_models(spark, root, horizon), key, feats, row_keys)
