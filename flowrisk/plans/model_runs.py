"""Training runs of all five horizons, their registry, and the scores of reloaded models.

The horizon-free features are computed once and staged; each horizon takes a narrow frame of
them with its own target, horizon features and complete rows (``shared_panel``, ``frame``).
``train`` fits what the manifest of the registry does not have yet (J8); ``best_scores`` scores
the hold-out rows with the model that their (station, horizon) chose, from the stored files
(M15, S16).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import col, complete
from flowrisk.operators import conformal as cf
from flowrisk.operators import cv
from flowrisk.operators import evaluate as ev
from flowrisk.operators import models as ml
from flowrisk.operators import registry
from flowrisk.operators.features import feature_names
from flowrisk.operators.metrics import decide, exceed, metric_table, persistence_prob
from flowrisk.plans import event_features as ef
from flowrisk.plans import training as tr
from flowrisk.session import checkpoint_dir, stage

KEY, STATION = tr.KEY, tr.STATION
ROW = [KEY, "row_idx"]
KEYS = ["station_id", "horizon_hours"]
#: Boosting rounds and depth of the registered query (25 fits); see the README.
ROUNDS, DEPTH = 3, 3


def shared_panel(spark: SparkSession, sf_dir: str, horizons=tr.HORIZONS_H) -> tuple[DataFrame, list[str]]:
    """The staged panel with the features of all horizons, and the names that all share."""
    feats = ef.horizon_catalogue(horizons)
    p, _ = ef.panel(spark, sf_dir, stretch=tr.STRETCH, dry=True, feats=feats)
    names = feature_names(feats)
    base = [n for n in names if "__" not in n]
    p = p.select(KEY, "rn", "time", "fill_ratio", *[col(n).cast("double").alias(n) for n in names])
    ready = stage(p.where(complete([*base, "fill_ratio"])), "all-horizons")
    number = ready.select(KEY).distinct().select(KEY, F.rank().over(tr._by_name()).cast("double").alias(STATION))
    return ready.join(number, KEY), base


def frame(shared: DataFrame, base: list[str], horizon: float) -> tuple[DataFrame, list[str]]:
    """Complete rows of one horizon with ordinal, hold-out flag and label; its feature columns."""
    names = [*base, *(n for n in ef.OF_HORIZON if n != "fill_ratio_target"), "fill_ratio"]
    own = {n: f"{n}__{horizon}" if n in ef.OF_HORIZON else n for n in names}
    safe = {f"f{i}": own[n] for i, n in enumerate(names)}      # dotted names are not vector-safe
    d = shared.select(KEY, "rn", "time", STATION, col(f"fill_ratio_target__{horizon}").alias("fill_ratio_target"),
                      *[col(n).alias(s) for s, n in safe.items()])
    d = stage(d.where(complete(d.columns)), "complete")     # as a table: no filter of 80 columns in later plans
    d = d.withColumn("fill_ratio", F.col(f"f{len(names) - 1}"))
    d = cv.holdout(cv.ordinal(d, KEY, "rn", F.floor(F.col("rn") / 4096)), tr.TEST_FRAC)
    return stage(d.withColumn("y", exceed("fill_ratio_target", tr.THRESHOLD)), "frame"), list(safe)


def fit_horizon(d: DataFrame, features: list[str], root: str, horizon: int, rounds: int, depth: int) -> DataFrame:
    """M7, M8, M9, M10, M12 for one horizon, stored in the registry.

    Returns the hold-out rows with ``p_fit``, the ensemble's probability before it was stored.
    """
    weights = stage(ml.fold_weights(d, KEY, tr.N_SPLITS), "weights")
    feats = [*features, STATION]
    models = ml.fit_fold_models(d, weights, KEY, feats, tr.N_SPLITS, tr.SEED, rounds, depth)
    train = d.where(~F.col("is_test"))
    oof = ml.out_of_fold(d, weights, models, KEY, feats, tr.N_SPLITS, ROW)
    conf = cf.conformal_threshold(train.select(*ROW, "y").join(oof, ROW, "left"), KEY, tr.ALPHA)
    fitted = ml.ensemble_predict(d.where("is_test"), weights, models, KEY, feats, ROW)
    out = stage(fitted.select(*ROW, F.col("p_ens").alias("p_fit")), "fitted")
    ranks = d.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features, 1)], "feature string, rank int")
    registry.save_run(root, horizon, models, weights, KEY, ranks, conf.select(KEY, "conf_threshold"),
                      d.select(KEY).distinct())
    return out


def train(spark: SparkSession, frames: dict[int, tuple[DataFrame, list[str]]], root: str,
          rounds: int = ROUNDS, depth: int = DEPTH) -> dict[int, DataFrame]:
    """Fits every horizon that has a station without a committed run; {horizon: fitted scores}."""
    stations = None
    for d, _ in frames.values():
        own = d.select(F.col(KEY).alias("station_id")).distinct()
        stations = own if stations is None else stations.union(own)
    left = tr.pending_runs(stations, frames, registry.finished(spark, root))
    todo = sorted(r["horizon_hours"] for r in left.select("horizon_hours").distinct().collect())  # at most the horizons
    with ThreadPoolExecutor(max(1, len(todo))) as pool:       # small fits of different horizons share the executors
        fitted = pool.map(lambda h: fit_horizon(*frames[h], root, h, rounds, depth), todo)
    return dict(zip(todo, fitted))


def model_rows(d: DataFrame, root: str, horizon: int) -> DataFrame:
    """Every model's probability and decision for the hold-out rows, from the stored models."""
    spark = d.sparkSession
    test = d.where("is_test")
    conf = registry.stored_thresholds(spark, root).where(F.col("horizon_hours") == horizon)
    ens = registry.score(test, root, horizon, KEY, ROW, [STATION])
    t = test.select(*ROW, "time", "y", "fill_ratio").join(ens, ROW, "left").join(
        conf.select(F.col("station_id").alias(KEY), "conf_threshold"), KEY, "left")
    pers = persistence_prob("fill_ratio")
    t = t.withColumn("_pm", F.coalesce("p_ens", pers))                                # M12
    conformal = F.when(F.col("p_ens").isNull(), decide(F.col("_pm"), 0.5)).otherwise(
        cf.conformal_decision("_pm", "conf_threshold"))
    parts = [("Persistence", pers, decide(pers, tr.THRESHOLD)), ("EnsembleClassifier", F.col("_pm"), decide(F.col("_pm"), 0.5)),
             ("ConformalEnsemble", F.col("_pm"), conformal)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p"), pred.cast("int").alias("pred"))
                               for n, p, pred in parts]))
    return t.select(F.col(KEY).alias("station_id"), F.lit(int(horizon)).alias("horizon_hours"), "row_idx", "time", "y",
                    "n_models", each.alias("m")).select("station_id", "horizon_hours", "row_idx", "time", "y", "n_models", "m.*")


def best_scores(scored: DataFrame) -> DataFrame:
    """Of all models' rows, those of the model that the (station, horizon) chose."""
    best = ev.best_models(metric_table(scored.select(*KEYS, "model", "y", "p", "pred"), KEYS))
    scored = scored.join(best, KEYS, "left")
    return scored.where(F.col("model") == F.coalesce("best_model", F.lit("Persistence"))).drop("best_model")


def run_all(spark: SparkSession, sf_dir: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Two training runs into ``root`` (the second fits what the first left), then all scores.

    Returns the scores of every model and (station, horizon, row, p_fit, run) of the fits."""
    shared, base = shared_panel(spark, sf_dir)
    frames = {h: frame(shared, base, h) for h in tr.HORIZONS_H}
    first = train(spark, {h: frames[h] for h in tr.HORIZONS_H[:2]}, root)
    second = train(spark, frames, root)
    fitted = None
    for run, found in ((1, first), (2, second)):
        for h, f in found.items():
            f = f.select(F.col(KEY).alias("station_id"), F.lit(int(h)).alias("horizon_hours"), "row_idx", "p_fit",
                         F.lit(run).alias("run"))
            fitted = f if fitted is None else fitted.unionByName(f)
    if fitted is None:                        # no station has complete rows
        fitted = spark.createDataFrame([], f"{KEYS[0]} string, {KEYS[1]} int, row_idx long, p_fit double, run int")
    scored = None
    for h, (d, _) in frames.items():
        s = model_rows(d, root, h)
        scored = s if scored is None else scored.unionByName(s)
    return stage(scored, "model-rows"), fitted


def fitted_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (station, horizon): hold-out rows, rows scored by the chosen model, usable folds, the run
    that fitted it, and the largest difference of a probability before storing and after reloading."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    scored, fitted = run_all(spark, sf_dir, root)
    ens = scored.where("model = 'EnsembleClassifier'").join(fitted, [*KEYS, "row_idx"], "left")
    rows = ens.groupBy(*KEYS).agg(
        F.count("*").alias("n_test"), F.count("p_fit").alias("n_fitted"), F.max("run").alias("run"),
        F.coalesce(F.max(F.round(F.abs(F.col("p") - F.col("p_fit")), 9)), F.lit(0.0)).alias("reload_diff"))
    chosen = best_scores(scored).groupBy(*KEYS).agg(
        F.count("p").alias("n_scored"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("n_outside"))
    folds = registry.stored_folds(spark, root).groupBy(*KEYS).agg(F.count_if("usable").alias("n_folds"))
    return rows.join(chosen, KEYS, "left").join(folds, KEYS, "left").select(
        *KEYS, "n_test", "n_scored", "n_outside", "n_folds", "n_fitted", "run", "reload_diff")


def fitted_model_scores_sql() -> str:
    """Rows, usable folds and runs; every row is scored, and reloading changes nothing."""
    parts = []
    for h in tr.HORIZONS_H:
        sql, feats = ef._oracle_panel_sql(h, tr.STRETCH, True)
        ok = " AND ".join(f'"{n}" IS NOT NULL' for n in feature_names(feats))
        k = tr.N_SPLITS
        parts.append(f"""SELECT * FROM ({sql},
c AS (SELECT event_type, CAST(fill_ratio_target > {tr.THRESHOLD} AS INTEGER) AS y,
             row_number() OVER (PARTITION BY event_type ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
      FROM f2 WHERE {ok} AND fill_ratio_target IS NOT NULL AND velocity_m_s IS NOT NULL),
h AS (SELECT *, CAST(floor(n * {1 - tr.TEST_FRAC}) AS BIGINT) AS m FROM c),
g AS (SELECT event_type, f, any_value(n - m) AS n_test,
             coalesce(sum(y) FILTER (i < m - ({k} - f + 1) * (m // {k + 1})), 0) AS n_pos,
             count(*) FILTER (i < m - ({k} - f + 1) * (m // {k + 1})) AS n_train
      FROM h CROSS JOIN range(1, {k + 1}) t(f) GROUP BY 1, 2)
SELECT event_type AS station_id, {h} AS horizon_hours, any_value(n_test) AS n_test, any_value(n_test) AS n_scored,
       0::BIGINT AS n_outside, count(*) FILTER (n_pos > 0 AND n_train > n_pos) AS n_folds FROM g GROUP BY 1)""")
    return f"""SELECT *, CASE WHEN n_folds > 0 THEN n_test ELSE 0 END AS n_fitted,
  CASE WHEN n_folds = 0 THEN NULL WHEN horizon_hours IN {tuple(tr.HORIZONS_H[:2])} THEN 1 ELSE 2 END AS run, 0.0::DOUBLE AS reload_diff
FROM ({" UNION ALL ".join(parts)})"""
