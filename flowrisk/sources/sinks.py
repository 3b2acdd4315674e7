"""Artifact writers (S14-S18).  Every output is a partitioned table written with
overwrite semantics per partition (dynamic partition overwrite), so a rerun for one
(station, horizon) replaces only its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.operators.evaluate import best_model_table


def _write(df: DataFrame, path: str, parts, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if parts:
        w = w.partitionBy(*parts)
    w.option("header", True).format(fmt).save(path)


def write_partitions(df: DataFrame, path: str, parts) -> None:
    """A table partitioned by ``parts``; only the partitions that ``df`` has are replaced."""
    _write(df, path, parts)


def write_metric_matrix(metrics_long: DataFrame, path: str) -> None:
    """(section, metric) x model matrix per (station, horizon), as CSV files."""
    wide = metrics_long.groupBy("station_id", "horizon_hours", "section", "metric") \
                       .pivot("model", ["Persistence", "EnsembleClassifier", "ConformalEnsemble"]) \
                       .agg(F.first("value"))
    _write(wide, path, ["station_id", "horizon_hours"], "csv")


def write_run_metadata(meta: DataFrame, path: str) -> None:
    """One JSON record per (station, horizon): threshold, alpha, conformal
    threshold, number of fold models, creation time, model of the sentence."""
    _write(meta.withColumn("created_at_utc", F.current_timestamp()), path,
           ["station_id", "horizon_hours"], "json")


def write_station_info(stations: DataFrame, path: str) -> None:
    """One JSON record per station (its monitor's attributes)."""
    _write(stations, path, ["station_id"], "json")


def write_feature_lists(features: DataFrame, path: str) -> None:
    """Kept features (feature, rank) per (station, horizon)."""
    _write(features, path, ["station_id", "horizon_hours"], "json")


def write_conformal_scores(scores: DataFrame, path: str) -> None:
    """Conformal scores as a long table (station, horizon, class, score)."""
    _write(scores, path, ["station_id", "horizon_hours"])


def save_models(models: dict, path: str) -> None:
    """Fold models with MLlib persistence (one folder per fold)."""
    for fold, m in models.items():
        m.write().overwrite().save(f"{path.rstrip('/')}/fold={fold}")


def write_best_model_table(best: DataFrame, path: str, horizons=None) -> None:
    """Station x horizon pivot of the chosen model as one CSV table."""
    best_model_table(best, horizons).repartition(1).write.mode("overwrite") \
        .option("header", True).csv(path)


def write_predictions(pred: DataFrame, path: str) -> None:
    """Prediction rows partitioned by station; reads with a station / horizon
    filter prune partitions (``PartitionFilters``) and push the rest to the scan."""
    _write(pred, path, ["station_id"])


def read_predictions(spark, path: str, station: str | None = None, horizon: int | None = None):
    df = spark.read.parquet(path)
    if station is not None:
        df = df.where(F.col("station_id") == station)
    if horizon is not None:
        df = df.where(F.col("horizon_hours") == horizon)
    return df
