"""Evaluation plan (E3) over a metric table that Spark derives from ``events``.

Stations are event types; for every horizon (1, 6, 24, 168 and 720 hours) the target is the
maximum fill ratio over the next H hours (W3) and ``y = target > 0.5`` (P8).  The event
history is lengthened threefold, since 720-hour targets need more than its 30 days, and an
hour without events has no load.  Three scores:

* Persistence: current fill ratio clipped to [0, 1], decision ``p >= 0.5`` (M13)
* EnsembleClassifier: 24-hour trailing maximum, decision ``p >= 0.5``
* ConformalEnsemble: same probability, calibrated decision ``p >= 0.6``

The metric table (M14) feeds the comparison (J12, A17), summaries (A18-A20) and the
rank-based model choice (W15, A21, A23), exactly as for stored metric files (S13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import rnd
from flowrisk.operators import evaluate as ev
from flowrisk.operators.metrics import decide, exceed, metric_table, persistence_prob
from flowrisk.operators.windows import Feat
from flowrisk.plans import event_panel as ep
from flowrisk.plans.event_features import STRETCH_FROM
from flowrisk.session import stage

HORIZONS = (1, 6, 24, 168, 720)
STRETCH = 3
THRESHOLD = 0.5
KEYS = ["station_id", "horizon_hours"]


def horizon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows (P6) of every station and horizon (J7): target, fill ratio, 24-hour maximum."""
    feats = [Feat(f"target_{h}", "next_max", "fill_ratio", h) for h in HORIZONS]
    feats.append(Feat("mx24", "trail_max", "fill_ratio", 24))
    p = ep.fill_panel(spark, sf_dir, feats, stretch=STRETCH, empty=0.0)
    hz = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"target_{h}").alias("t"))
                             for h in HORIZONS]))
    lg = p.select(F.col("event_type").alias("station_id"), "rn", "time", "fill_ratio", "mx24", hz.alias("_x"))
    lg = lg.select("station_id", F.col("_x.h").alias("horizon_hours"), "rn", "time", "fill_ratio", "mx24",
                   F.col("_x.t").alias("target"))
    return lg.dropna(subset=["target", "fill_ratio", "mx24"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = horizon_rows(spark, sf_dir).withColumn("y", exceed("target", THRESHOLD))
    pers = persistence_prob("fill_ratio")
    ens = persistence_prob("mx24")
    parts = [("Persistence", pers, decide(pers, THRESHOLD)),
             ("EnsembleClassifier", ens, decide(ens, THRESHOLD)),
             ("ConformalEnsemble", ens, decide(ens, 0.6))]
    # one row per model from one pass over the windowed panel
    models = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), prob.alias("p"), pred.alias("pred"))
                                for name, prob, pred in parts]))
    return lg.select(*KEYS, "y", models)


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the scored rows feed several aggregations: computed once, staged in the
    # checkpoint folder, instead of recomputing the windowed panel per branch
    return metric_table(stage(scored(spark, sf_dir), "scored"), KEYS)


def comparison(spark, sf_dir):
    c = ev.compare_to_baseline(metrics_long(spark, sf_dir))
    return c.select(*KEYS, "metric", "model", rnd("persistence").alias("persistence"),
                    rnd("model_value").alias("model_value"), rnd("pct_diff", 4).alias("pct_diff"),
                    "beat_persistence")


def summary(spark, sf_dir):
    s = ev.improvement_summary(ev.compare_to_baseline(metrics_long(spark, sf_dir)))
    return s.select("horizon_hours", "model", "metric", rnd("mean_pct_diff", 4).alias("mean_pct_diff"),
                    rnd("std_pct_diff", 4).alias("std_pct_diff"), "n")


def beat_rates(spark, sf_dir, by_metric=False):
    b = ev.beat_rate(ev.compare_to_baseline(metrics_long(spark, sf_dir)), by_metric)
    return b.withColumn("beat_rate_pct", rnd("beat_rate_pct", 6))


def best(spark, sf_dir):
    return ev.best_models(metrics_long(spark, sf_dir))


def best_table(spark, sf_dir):
    return ev.best_model_table(best(spark, sf_dir), HORIZONS)


# ----------------------------------------------------------------------------- oracle
def _guard(frame: str, n: int) -> str:
    w = f"(PARTITION BY event_type ORDER BY t ROWS BETWEEN {frame})"
    return f"CASE WHEN count(fill_ratio) OVER {w} = {n} THEN max(fill_ratio) OVER {w} END"


_TARGETS = ",\n    ".join(f"{_guard(f'1 FOLLOWING AND {h} FOLLOWING', h)} AS target_{h}"
                          for h in HORIZONS)
_CASE = " ".join(f"WHEN {h} THEN target_{h}" for h in HORIZONS)
_CLIP = "least(greatest({}, 0.0), 1.0)"

FEATURES_SQL = f"""
WITH ev AS (SELECT TIMESTAMP '{STRETCH_FROM}' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '{STRETCH_FROM}'))
                   * {STRETCH}) AS ts, event_type, value FROM events),
hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS t, sum(round(value * 100)) / 100.0 AS load
  FROM ev GROUP BY 1, 2),
cap AS (SELECT event_type, max(load) AS capacity, min(t) AS t0, max(t) AS t1 FROM hourly GROUP BY 1),
grid AS (SELECT event_type, capacity, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t FROM cap),
panel AS (SELECT g.event_type, g.t, coalesce(h.load, 0) / g.capacity AS fill_ratio
          FROM grid g LEFT JOIN hourly h ON h.event_type = g.event_type AND h.t = g.t),
feat AS (SELECT event_type, t, fill_ratio,
    {_TARGETS},
    {_guard('23 PRECEDING AND CURRENT ROW', 24)} AS mx24
  FROM panel),
lg AS (SELECT event_type AS station_id, hz.horizon_hours, t, fill_ratio, mx24,
              CASE hz.horizon_hours {_CASE} END AS target
       FROM feat CROSS JOIN (VALUES {", ".join(f"({h})" for h in HORIZONS)}) hz(horizon_hours)),
"""

METRICS_LONG_SQL = FEATURES_SQL + f"""base AS (SELECT station_id, horizon_hours, fill_ratio, mx24,
                CASE WHEN target > {THRESHOLD} THEN 1 ELSE 0 END AS y
         FROM lg WHERE target IS NOT NULL AND fill_ratio IS NOT NULL AND mx24 IS NOT NULL),
s AS (
  SELECT station_id, horizon_hours, 'Persistence' AS model, y, {_CLIP.format('fill_ratio')} AS p,
         CASE WHEN {_CLIP.format('fill_ratio')} >= 0.5 THEN 1 ELSE 0 END AS pred FROM base
  UNION ALL
  SELECT station_id, horizon_hours, 'EnsembleClassifier', y, {_CLIP.format('mx24')},
         CASE WHEN {_CLIP.format('mx24')} >= 0.5 THEN 1 ELSE 0 END FROM base
  UNION ALL
  SELECT station_id, horizon_hours, 'ConformalEnsemble', y, {_CLIP.format('mx24')},
         CASE WHEN {_CLIP.format('mx24')} >= 0.6 THEN 1 ELSE 0 END FROM base),
dm AS (
  SELECT station_id, horizon_hours, model,
         count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
         count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
         count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn
  FROM s GROUP BY 1, 2, 3),
ps AS (SELECT * FROM s WHERE model <> 'ConformalEnsemble'),
pm0 AS (SELECT station_id, horizon_hours, model, avg(abs(p - y)) AS MAE,
               avg((p - y) * (p - y)) AS MSE, sum(y) AS npos, sum(1 - y) AS nneg
        FROM ps GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.station_id, a.horizon_hours, a.model,
         sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS wins
  FROM ps a JOIN ps b ON a.station_id = b.station_id AND a.horizon_hours = b.horizon_hours
   AND a.model = b.model AND a.y = 1 AND b.y = 0
  GROUP BY 1, 2, 3),
thr AS (
  SELECT t.station_id, t.horizon_hours, t.model, t.npos_at,
         (SELECT count(*) FROM ps x WHERE x.station_id = t.station_id AND
            x.horizon_hours = t.horizon_hours AND x.model = t.model AND x.p >= t.p AND x.y = 1) AS tp_at,
         (SELECT count(*) FROM ps x WHERE x.station_id = t.station_id AND
            x.horizon_hours = t.horizon_hours AND x.model = t.model AND x.p >= t.p) AS all_at
  FROM (SELECT station_id, horizon_hours, model, p, count(*) AS npos_at FROM ps WHERE y = 1
        GROUP BY 1, 2, 3, 4) t),
ap AS (SELECT station_id, horizon_hours, model, sum(npos_at * tp_at / all_at) AS num
       FROM thr GROUP BY 1, 2, 3),
pm1 AS (
  SELECT pm0.station_id, pm0.horizon_hours, pm0.model, MAE, MSE, MSE AS Brier,
         CASE WHEN npos > 0 AND nneg > 0 THEN pairs.wins / (npos * nneg) END AS ROC_AUC,
         CASE WHEN npos = 0 THEN 0.0 ELSE coalesce(ap.num, 0) / npos END AS PR_AUC
  FROM pm0 LEFT JOIN pairs USING (station_id, horizon_hours, model)
           LEFT JOIN ap USING (station_id, horizon_hours, model)),
pm AS (SELECT * FROM pm1 UNION ALL
       SELECT station_id, horizon_hours, 'ConformalEnsemble', MAE, MSE, Brier, ROC_AUC, PR_AUC
       FROM pm1 WHERE model = 'EnsembleClassifier'),
wide AS (
  SELECT pm.*,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS Precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS Recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS F1,
         CASE WHEN tn + fp = 0 THEN NULL ELSE tn / (tn + fp) END AS Specificity
  FROM pm JOIN dm USING (station_id, horizon_hours, model)),
ml AS (
  SELECT station_id, horizon_hours, model, 'exceedance_metrics' AS section, metric, value
  FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN
       (MAE, MSE, Brier, PR_AUC, ROC_AUC, Precision, Recall, F1, Specificity))),
"""

_LOWER = "('MAE', 'MSE', 'Brier')"
_ALL = "('Brier', 'F1', 'MAE', 'MSE', 'PR_AUC', 'Precision', 'ROC_AUC', 'Recall', 'Specificity')"

CMP_SQL = METRICS_LONG_SQL + f"""
bse AS (SELECT station_id, horizon_hours, metric, value AS persistence FROM ml
        WHERE section = 'exceedance_metrics' AND model = 'Persistence' AND metric IN {_ALL}
          AND value IS NOT NULL AND value <> 0),
cmp AS (
  SELECT m.station_id, m.horizon_hours, m.metric, m.model, b.persistence, m.value AS model_value,
         CASE WHEN m.metric IN {_LOWER} THEN 100.0 * (b.persistence - m.value) / abs(b.persistence)
              ELSE 100.0 * (m.value - b.persistence) / abs(b.persistence) END AS pct_diff,
         CASE WHEN m.metric IN {_LOWER} THEN m.value < b.persistence
              ELSE m.value > b.persistence END AS beat_persistence
  FROM ml m JOIN bse b USING (station_id, horizon_hours, metric)
  WHERE m.section = 'exceedance_metrics' AND m.metric IN {_ALL}
    AND m.model IN ('EnsembleClassifier', 'ConformalEnsemble') AND m.value IS NOT NULL)
"""

COMPARISON_SQL = CMP_SQL + """
SELECT station_id, horizon_hours, metric, model, round(persistence, 6) AS persistence,
       round(model_value, 6) AS model_value, round(pct_diff, 4) AS pct_diff, beat_persistence
FROM cmp"""

SUMMARY_SQL = CMP_SQL + """
SELECT horizon_hours, model, metric, round(avg(pct_diff), 4) AS mean_pct_diff,
       round(stddev_samp(pct_diff), 4) AS std_pct_diff, count(pct_diff) AS n
FROM cmp GROUP BY 1, 2, 3"""

BEAT_RATE_SQL = CMP_SQL + """
SELECT horizon_hours, model, round(100.0 * avg(CAST(beat_persistence AS DOUBLE)), 6) AS beat_rate_pct,
       count(beat_persistence) AS n
FROM cmp GROUP BY 1, 2"""

BEAT_RATE_BY_METRIC_SQL = CMP_SQL + """
SELECT horizon_hours, model, metric,
       round(100.0 * avg(CAST(beat_persistence AS DOUBLE)), 6) AS beat_rate_pct,
       count(beat_persistence) AS n
FROM cmp GROUP BY 1, 2, 3"""

BEST_SQL = METRICS_LONG_SQL + f"""
ex AS (SELECT * FROM ml WHERE section = 'exceedance_metrics' AND metric IN {_ALL}),
okm AS (SELECT station_id, horizon_hours, metric FROM ex GROUP BY 1, 2, 3
        HAVING count(value) = 3),
rk AS (
  SELECT e.station_id, e.horizon_hours, e.metric, e.model,
         CASE WHEN e.metric IN {_LOWER} THEN e.value ELSE -e.value END AS k
  FROM ex e JOIN okm USING (station_id, horizon_hours, metric)),
rk2 AS (
  SELECT station_id, horizon_hours, model,
         rank() OVER (PARTITION BY station_id, horizon_hours, metric ORDER BY k)
         + (count(*) OVER (PARTITION BY station_id, horizon_hours, metric, k) - 1) / 2.0 AS r
  FROM rk),
avgr AS (SELECT station_id, horizon_hours, model, avg(r) AS a FROM rk2 GROUP BY 1, 2, 3),
best AS (
  SELECT station_id, horizon_hours,
         arg_min(model, round(a, 9) * 1000 + CASE model WHEN 'Persistence' THEN 1
                 WHEN 'EnsembleClassifier' THEN 2 ELSE 3 END) AS best_model
  FROM avgr GROUP BY 1, 2)
"""

BEST_MODEL_SQL = BEST_SQL + "SELECT station_id, horizon_hours, best_model FROM best"

BEST_TABLE_SQL = BEST_SQL + "SELECT station_id, " + ", ".join(
    f"max(CASE WHEN horizon_hours = {h} THEN best_model END) AS \"{h}\"" for h in HORIZONS
) + " FROM best GROUP BY station_id"
