"""Model evaluation against the persistence baseline (E3: S13, A17-A23, J12, W15,
P16, P17, T7, F14, X2, X3).

Input is the long metric table ``(station_id, horizon_hours, section, metric, model,
value)``.  Everything is grouped aggregation plus one self-join; the per-group Python
``apply`` of a pandas design becomes a rank window over 3-row groups and ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.operators.metrics import HIGHER_BETTER, LOWER_BETTER

# Fixed values that must match the reference's evaluation:
BASELINE = "Persistence"
CANDIDATES = ("EnsembleClassifier", "ConformalEnsemble")
# order used to break ties between equal average ranks
MODEL_ORDER = ("Persistence", "EnsembleClassifier", "ConformalEnsemble")
COMPARE_METRICS = tuple(sorted(LOWER_BETTER + HIGHER_BETTER))
EXCEEDANCE = "exceedance_metrics"
KEYS = ("station_id", "horizon_hours")


def read_metric_files(spark: SparkSession, base_dir: str) -> DataFrame:
    """S13 + A22 + F14: ``{base}/<station>/<H>hr/metrics.csv`` -> long table.

    Station and horizon come from the path; a non-integer horizon folder is skipped;
    values that do not parse become NULL (blank cells stay NULL).
    """
    schema = T.StructType([T.StructField("section", T.StringType()),
                           T.StructField("metric", T.StringType())] +
                          [T.StructField(m, T.StringType()) for m in MODEL_ORDER])
    raw = (spark.read.schema(schema).option("header", True)
           .csv(f"{base_dir.rstrip('/')}/*/*hr/metrics.csv")
           .withColumn("_path", F.col("_metadata.file_path")))
    pat = r"/([^/]+)/([^/]+)hr/metrics\.csv$"
    raw = raw.select(
        F.regexp_extract("_path", pat, 1).alias("station_id"),
        F.expr(f"try_cast(regexp_extract(_path, '{pat}', 2) AS INT)").alias("horizon_hours"),
        "section", "metric", *MODEL_ORDER).where(F.col("horizon_hours").isNotNull())
    long = raw.unpivot(["station_id", "horizon_hours", "section", "metric"], list(MODEL_ORDER),
                       "model", "value")
    return long.withColumn("value", F.expr("try_cast(value AS DOUBLE)"))


def _lower(metric_col: str = "metric"):
    return F.col(metric_col).isin(*LOWER_BETTER)


def compare_to_baseline(long: DataFrame) -> DataFrame:
    """J12 + A17: candidate rows paired with the baseline of the same
    (station, horizon, metric); baselines NULL or 0 and NULL candidates are skipped."""
    ex = long.where((F.col("section") == EXCEEDANCE) & F.col("metric").isin(*COMPARE_METRICS))
    base = ex.where(F.col("model") == BASELINE).select(*KEYS, "metric",
                                                       F.col("value").alias("persistence"))
    base = base.where(F.col("persistence").isNotNull() & (F.col("persistence") != 0))
    cand = ex.where(F.col("model").isin(*CANDIDATES) & F.col("value").isNotNull()).select(
        *KEYS, "metric", "model", F.col("value").alias("model_value"))
    j = cand.join(base, [*KEYS, "metric"])
    pb, mv = F.col("persistence"), F.col("model_value")
    pct = F.when(_lower(), (pb - mv) / F.abs(pb)).otherwise((mv - pb) / F.abs(pb)) * 100.0
    beat = F.when(_lower(), mv < pb).otherwise(mv > pb)
    return j.select(*KEYS, "metric", "model", "persistence", "model_value",
                    pct.alias("pct_diff"), beat.alias("beat_persistence"))


def improvement_summary(cmp: DataFrame) -> DataFrame:
    """Mean / sample std / count of the % improvement by (horizon, model, metric)."""
    return cmp.groupBy("horizon_hours", "model", "metric").agg(
        F.avg("pct_diff").alias("mean_pct_diff"), F.stddev_samp("pct_diff").alias("std_pct_diff"),
        F.count("pct_diff").alias("n"))


def beat_rate(cmp: DataFrame, by_metric: bool = False) -> DataFrame:
    """Share (in %) of comparisons where the model beat the baseline."""
    g = ["horizon_hours", "model"] + (["metric"] if by_metric else [])
    return cmp.groupBy(*g).agg(
        (F.avg(F.col("beat_persistence").cast("double")) * 100.0).alias("beat_rate_pct"),
        F.count("beat_persistence").alias("n"))


def metric_ranks(long: DataFrame) -> DataFrame:
    """Tie-averaged rank of each model per (station, horizon, metric), using only
    metrics where all three models have a value."""
    ex = long.where((F.col("section") == EXCEEDANCE) & F.col("metric").isin(*COMPARE_METRICS)
                    & F.col("model").isin(*MODEL_ORDER))
    g = [*KEYS, "metric"]
    full = Window.partitionBy(*g)
    ex = ex.withColumn("_nv", F.count("value").over(full)).where(F.col("_nv") == len(MODEL_ORDER))
    # rank ascending for lower-better metrics, descending otherwise: rank on signed value
    key = F.when(_lower(), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy(*g).orderBy(key)
    ties = Window.partitionBy(*g, key)
    return ex.select(*g, "model", (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
                     .alias("rank"))


def best_models(long: DataFrame) -> DataFrame:
    """Lowest average rank per (station, horizon); ties go to the earlier model in
    Persistence, EnsembleClassifier, ConformalEnsemble."""
    r = metric_ranks(long).groupBy(*KEYS, "model").agg(F.avg("rank").alias("avg_rank"))
    order = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    r = r.withColumn("_o", F.struct(F.round("avg_rank", 9).alias("a"), order.alias("o")))
    return r.groupBy(*KEYS).agg(F.min_by("model", "_o").alias("best_model"))


def best_model_table(best: DataFrame, horizons=None) -> DataFrame:
    """Station x horizon pivot of the chosen model."""
    p = best.groupBy("station_id")
    p = p.pivot("horizon_hours", list(horizons)) if horizons else p.pivot("horizon_hours")
    return p.agg(F.first("best_model"))
