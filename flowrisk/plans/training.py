"""Training plan (E1) on the 10-minute event panel.

One lazily built plan for all stations: the station loop is a partition key and one model
per horizon and fold is fitted on the pooled panel, with the station as a feature.

panel with all features (history stretched so that the 30-day windows fill) -> complete
rows (P6) -> ordinal + hold-out (W18, M1) -> feature selection on the training rows
(M3 -> M4 -> M5 -> A14 -> M6 -> T3 -> T4) -> forward folds (M2) with weights per station
(A5) -> fold classifiers (M7) -> out-of-fold scores (M8) -> conformal threshold per station
(M10, M11) -> ensemble on the hold-out (M9) -> persistence for stations without a usable
fold (M12) -> metric table (M13, M14).

Boosting rounds and depth are parameters; the operators default to 500 rounds and depth 6,
the registered query uses ``ROUNDS`` and ``DEPTH`` (see the README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import col, complete, rnd
from flowrisk.operators import conformal as cf
from flowrisk.operators import cv
from flowrisk.operators import models as ml
from flowrisk.operators import select as sel
from flowrisk.operators.features import feature_names
from flowrisk.operators.grid import regular_grid
from flowrisk.operators.halo import HaloSpec
from flowrisk.operators.metrics import class_counts, decide, exceed, metric_table, persistence_prob, \
    regression_metrics
from flowrisk.operators.windows import Feat, compute_features, halo_of, rows
from flowrisk.plans import event_features as ef
from flowrisk.session import stage
from flowrisk.sources.tables import table

# exceedance level: the event panel's capacity is the largest slot, so half of it
THRESHOLD = 0.5
ALPHA = 0.10
TEST_FRAC = 0.2
N_SPLITS = 5
SEED = 42
ROUNDS, DEPTH = 20, 4
STRETCH = 3                     # 30 days of events become 90: a 30-day look-back and 30-day horizon
HORIZONS_H = (1, 6, 24, 168, 720)
KEY = "event_type"
STATION = "station_no"
NOT_INPUT = {"fill_ratio_target"}


def model_frame(spark: SparkSession, sf_dir: str, horizon_hours: float = ef.HORIZON_H,
                features: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Complete rows with ordinal, hold-out flag and label; {column: feature name}.

    The staged table is read by every fit: ordinals and roles are in it, so that no fit
    computes them again."""
    p, feats = ef.panel(spark, sf_dir, horizon_hours=horizon_hours, stretch=STRETCH, dry=True)
    names = features or [n for n in feature_names(feats) if n not in NOT_INPUT]
    if "fill_ratio" not in names:
        names = names + ["fill_ratio"]                # appended only if absent
    missing = [c for c in names if c not in p.columns]  # P11
    if missing:
        raise KeyError(f"model frame is missing required feature columns: {missing}")
    safe = {f"f{i}": n for i, n in enumerate(names)}  # dotted names are not vector-safe
    p = p.select(KEY, "rn", "time", "fill_ratio_target", *[col(n).cast("double").alias(s) for s, n in safe.items()])
    d = stage(p.where(complete(p.columns)), "panel")    # P6: complete rows only
    stations = d.groupBy(KEY).agg(F.min("time").alias("_t"))      # one row per station
    number = stations.select(KEY, F.rank().over(_by_name()).cast("double").alias(STATION))
    d = d.join(number, KEY)
    d = d.withColumn("fill_ratio", F.col(next(s for s, n in safe.items() if n == "fill_ratio")))
    d = cv.holdout(cv.ordinal(d, KEY, "rn", F.floor(F.col("rn") / 4096)), TEST_FRAC)
    return stage(d.withColumn("y", exceed("fill_ratio_target", THRESHOLD)), "model-frame"), safe


def _by_name():
    from pyspark.sql import Window
    return Window.orderBy(KEY)                          # over the station dimension only


def select_features(d: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH,
                    frac: float = 0.05, corr_threshold: float = 0.9) -> DataFrame:
    """M3 -> M4 -> M5 -> A14 -> M6 -> T3 -> T4 on the training rows: kept features with rank.

    The regressor trains on the last of three forward folds and every validation row of it
    is scored for the importance."""
    train, val = (cv.fold_part(d, 3, 3, role) for role in ("train", "val"))
    model = ml.fit_regressor(train, features, "fill_ratio_target", SEED, rounds, depth)
    imp = stage(ml.permutation_importance(model, val.select(KEY, "row_idx", "fill_ratio_target", *features), features,
                                          "fill_ratio_target", [KEY, "row_idx"], SEED), "importance")
    kept = sel.importance_filter(imp, frac)
    names = [r["feature"] for r in kept.select("feature").collect()]   # at most the features
    nodes = kept.select("feature")
    pairs = sel.correlation_pairs(train, sorted(names)) if len(names) > 1 else None
    edges = nodes.select(F.col("feature").alias("a"), F.col("feature").alias("b")).limit(0)
    if pairs is not None:
        edges = pairs.where(F.col("abs_corr") >= corr_threshold).select("a", "b")
    groups = sel.connected_components(d.sparkSession, nodes, edges)
    return sel.group_representatives(groups, kept)


def scored_holdout(spark: SparkSession, sf_dir: str, horizon_hours: float = ef.HORIZON_H,
                   rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    d, safe = model_frame(spark, sf_dir, horizon_hours)
    row = [KEY, "row_idx"]
    train = d.where(~F.col("is_test"))
    kept = [r["feature"] for r in select_features(train, list(safe), rounds, depth).orderBy("rank").collect()]
    feats = [*kept, STATION]
    weights = stage(ml.fold_weights(d, KEY, N_SPLITS), "weights")
    models = ml.fit_fold_models(d, weights, KEY, feats, N_SPLITS, SEED, rounds, depth)
    oof = ml.out_of_fold(d, weights, models, KEY, feats, N_SPLITS, row)
    train_oof = train.select(*row, "y").join(oof, row, "left")
    conf = cf.conformal_threshold(train_oof, KEY, ALPHA).select(KEY, "conf_threshold")
    test = d.where(F.col("is_test"))
    ens = ml.ensemble_predict(test, weights, models, KEY, feats, row)
    t = test.select(*row, "y", "fill_ratio", "fill_ratio_target").join(ens, row, "left") \
            .join(conf, KEY, "left")
    pers = persistence_prob("fill_ratio")
    # A station without a usable fold gets its clipped persistence probability
    p_model = F.coalesce(F.col("p_ens"), pers)
    parts = [("Persistence", pers, decide(pers, THRESHOLD)),
             ("EnsembleClassifier", p_model, decide(p_model, 0.5)),
             ("ConformalEnsemble", p_model,
              F.when(F.col("p_ens").isNull(), decide(p_model, 0.5))
              .otherwise(cf.conformal_decision("_pm", "conf_threshold")))]
    t = t.withColumn("_pm", p_model)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), prob.alias("p"), pred.cast("int").alias("pred"))
                               for name, prob, pred in parts]))
    t = t.select(F.col(KEY).alias("station_id"), F.lit(horizon_hours).cast("int").alias("horizon_hours"), "y",
                 "fill_ratio", "fill_ratio_target", "n_models", each.alias("m"))
    return stage(t.select("station_id", "horizon_hours", "m.model", "y", "m.p", "m.pred", "fill_ratio",
                          "fill_ratio_target", "n_models"), "scored")


def training_metrics(spark: SparkSession, sf_dir: str, horizon_hours: float = ef.HORIZON_H
                     ) -> DataFrame:
    """Long metric table: exceedance metrics of 3 models + continuous persistence."""
    sc = scored_holdout(spark, sf_dir, horizon_hours)
    keys = ["station_id", "horizon_hours"]
    ex = metric_table(sc.select(*keys, "model", "y", "p", "pred"), keys)
    cont = regression_metrics(sc.where(F.col("model") == "Persistence"), keys,
                              "fill_ratio_target", "fill_ratio")
    cont = cont.unpivot(keys, ["MAE", "MSE"], "metric", "value") \
               .withColumn("model", F.lit("Persistence")) \
               .withColumn("section", F.lit("continuous_metrics"))
    return ex.unionByName(cont)


# ------------------------------------------------------------- checks around the fits
def training_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M7, A4, A5: what every (station, fold) of the 6-hour model trains on."""
    d, _ = model_frame(spark, sf_dir)
    w = ml.fold_weights(d, KEY, N_SPLITS)
    n = class_counts(d, KEY).select(KEY, F.col("n").alias("n_rows"), F.col("n_pos").alias("n_pos_all"), "n_classes")
    return w.join(n, KEY).select(KEY, "fold", "n_rows", "n_pos_all", "n_classes", "n_train_rows", "n_pos", "n_neg",
                                 "n_val", rnd("weight", 6).alias("weight"), "usable")


def training_folds_sql() -> str:
    sql, feats = ef._oracle_panel_sql(ef.HORIZON_H, STRETCH, True)
    ok = " AND ".join(f'"{n}" IS NOT NULL' for n in feature_names(feats))
    return sql + f""",
c AS (SELECT event_type, CAST(fill_ratio_target > {THRESHOLD} AS INTEGER) AS y,
             row_number() OVER (PARTITION BY event_type ORDER BY rn) - 1 AS i,
             count(*) OVER (PARTITION BY event_type) AS n
      FROM f2 WHERE {ok} AND fill_ratio_target IS NOT NULL AND velocity_m_s IS NOT NULL),
h AS (SELECT *, CAST(floor(n * {1 - TEST_FRAC}) AS BIGINT) AS m FROM c),
g AS (SELECT h.*, CAST(f AS INTEGER) AS fold, m // {N_SPLITS + 1} AS ts FROM h CROSS JOIN range(1, {N_SPLITS + 1}) t(f)),
s AS (SELECT event_type, fold, any_value(n) AS n_rows, sum(y) AS n_pos_all, count(DISTINCT y) AS n_classes,
             count(*) FILTER (i < m - ({N_SPLITS} - fold + 1) * ts) AS n_train_rows,
             coalesce(sum(y) FILTER (i < m - ({N_SPLITS} - fold + 1) * ts), 0) AS n_pos,
             count(*) FILTER (i >= m - ({N_SPLITS} - fold + 1) * ts AND i < m - ({N_SPLITS} - fold) * ts) AS n_val
      FROM g GROUP BY 1, 2)
SELECT event_type, fold, n_rows, CAST(n_pos_all AS BIGINT) AS n_pos_all, n_classes, n_train_rows,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_train_rows - n_pos AS BIGINT) AS n_neg, n_val,
       round(greatest(n_train_rows - n_pos, 1) / greatest(n_pos, 1), 6) AS weight,
       n_pos > 0 AND n_train_rows > n_pos AS usable
FROM s"""


def horizon_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a target and exceedances for all five horizons (up to 4,320 rows
    of the 10-minute grid ahead) per station."""
    freq = ef.FREQ_MIN
    ev = ef.stretched(table(spark, sf_dir, "events").select("ts", KEY, "value"), STRETCH)
    obs = ev.groupBy(KEY, ef._slot("ts", ef.STEP_S).alias("time")).agg(
        F.sum(F.round(F.col("value") * 100)).cast("long").alias("load"))
    feats = [Feat(f"t{h}", "next_max", "fill_ratio", rows(h, freq)) for h in HORIZONS_H]
    back, ahead = halo_of(feats)
    lay = regular_grid(obs, KEY, "time", ef.STEP_S, HaloSpec(1 << 16, back, ahead).fitted())
    cap = obs.groupBy(KEY).agg(F.max("load").alias("_cap"))
    lay = lay.join(cap, KEY).withColumn("fill_ratio", F.coalesce("load", F.lit(0)) / F.col("_cap"))
    p = compute_features(lay, KEY, feats, freq / 60.0, keep=[KEY, "rn", "time", "fill_ratio"])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"t{h}").alias("t")) for h in HORIZONS_H]))
    return p.select(F.col(KEY).alias("station_id"), each.alias("x")).groupBy(
        "station_id", F.col("x.h").alias("horizon_hours")).agg(
        F.count("x.t").alias("n_target"), F.count_if(F.col("x.t") > THRESHOLD).alias("n_exceed"),
        rnd(F.max("x.t"), 6).alias("max_target"), rnd(F.min("x.t"), 6).alias("min_target"))


def horizon_targets_sql() -> str:
    rows_of = {h: rows(h, ef.FREQ_MIN) for h in HORIZONS_H}
    win = ", ".join(f"w{h} AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
                    for h, n in rows_of.items())
    cols = ", ".join(f"CASE WHEN count(*) OVER w{h} = {n} THEN max(fill) OVER w{h} END AS t{h}" for h, n in rows_of.items())
    union = " UNION ALL ".join(f"SELECT event_type, {h} AS h, t{h} AS t FROM f" for h in rows_of)
    return f"""
WITH ev AS (SELECT TIMESTAMP '{ef.STRETCH_FROM}' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '{ef.STRETCH_FROM}'))
                   * {STRETCH}) AS ts, event_type, value FROM events),
o AS (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS time, sum(round(value * 100)) AS load FROM ev GROUP BY 1, 2),
b AS (SELECT event_type, min(time) AS t0, max(time) AS t1, max(load) AS cap FROM o GROUP BY 1),
g AS (SELECT event_type, cap, unnest(generate_series(t0, t1, INTERVAL 10 MINUTE)) AS time FROM b),
p AS (SELECT g.event_type, g.time, coalesce(load, 0) / cap AS fill FROM g LEFT JOIN o USING (event_type, time)),
f AS (SELECT *, {cols} FROM p WINDOW {win}),
u AS ({union})
SELECT event_type AS station_id, h AS horizon_hours, count(t) AS n_target, count(*) FILTER (t > {THRESHOLD}) AS n_exceed,
       round(max(t), 6) AS max_target, round(min(t), 6) AS min_target
FROM u GROUP BY 1, 2"""


def pending_runs(stations: DataFrame, horizons, done: DataFrame | None) -> DataFrame:
    """J7 + J8: every (station, horizon) pair not yet present in the run metadata.

    ``horizons`` is a short parameter list, expanded with ``explode``; the finished
    runs are removed with a left anti-join."""
    pairs = stations.select("station_id").distinct().select(
        "station_id", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_hours"))
    if done is None:
        return pairs
    return pairs.join(done.select("station_id", "horizon_hours"), ["station_id", "horizon_hours"],
                      "left_anti")
