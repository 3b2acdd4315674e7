"""Risk table on the hourly event panel.

Stations are event types, the horizons those of the evaluation.  Calibration scores come from the
training part (first 80 % of rows) with the 24-hour trailing maximum as probability;
the hold-out rows are scored by the best model of their (station, horizon) (J10, M15):
persistence uses the clipped fill ratio, the ensembles the clipped trailing maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import rnd
from flowrisk.operators import cv
from flowrisk.operators import evaluate as ev
from flowrisk.operators import risk as rk
from flowrisk.operators.metrics import exceed, persistence_prob
from flowrisk.plans import evaluation as evq
from flowrisk.session import stage

KEYS = ["station_id", "horizon_hours"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = evq.horizon_rows(spark, sf_dir)
    return cv.holdout(cv.ordinal(lg, KEYS, "rn", F.floor(F.col("rn") / 4096)), 0.2)


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stage(rows(spark, sf_dir), "risk-rows")
    ml = stage(evq.metrics_long(spark, sf_dir), "risk-metrics")           # small table
    tr = r.where(~F.col("is_test")).select(*KEYS, exceed("target", 0.5).alias("y"),
                                           persistence_prob("mx24").alias("p"))
    cso = tr.where(F.col("y") == 1).select(*KEYS, (1.0 - F.col("p")).alias("s"))
    safe = tr.where(F.col("y") == 0).select(*KEYS, F.col("p").alias("s"))
    n = tr.groupBy(*KEYS).agg(F.count_if(F.col("y") == 1).alias("n_cso"),
                              F.count_if(F.col("y") == 0).alias("n_safe"))
    best = ev.best_models(ml)                                              # J10
    t = r.where(F.col("is_test")).join(best, KEYS, "left")
    p = F.when(F.col("best_model") == "Persistence", persistence_prob("fill_ratio")) \
         .otherwise(persistence_prob("mx24"))                              # M15
    t = t.select(*KEYS, "time", F.coalesce("best_model", F.lit("Persistence")).alias("model"),
                 p.alias("p"))
    t = t.withColumn("one_minus_p", 1.0 - F.col("p"))
    t = rk.count_at_least(t, cso, KEYS, "one_minus_p", "s", "cnt_cso")
    t = rk.count_at_least(t, safe, KEYS, "p", "s", "cnt_safe")
    t = t.join(n, KEYS, "left").fillna(0, ["n_cso", "n_safe"])
    t = rk.risk_columns(t)
    t = rk.trend(t, KEYS, "time", 3600)                                    # W19
    rate = ev.beat_rate(ev.compare_to_baseline(ml))
    t = t.join(rate.select(F.col("horizon_hours"), F.col("model"), "beat_rate_pct"),
               ["horizon_hours", "model"], "left")
    sentence = F.when(F.col("beat_rate_pct").isNull(),
                      F.format_string("%s is the persistence baseline at %d h", "model", "horizon_hours")) \
                .otherwise(F.format_string("%s beat persistence in %.1f%% of comparisons at %d h",
                                           "model", F.round("beat_rate_pct", 1), "horizon_hours"))
    return t.select(*KEYS, "time", "model", rnd("risk_percent", 6).alias("risk_percent"),
                    "risk_category", rnd("p_cso", 6).alias("p_cso"), rnd("p_safe", 6).alias("p_safe"),
                    rnd("confidence_percent", 6).alias("confidence_percent"),
                    "confidence_category", "confidence_direction", "trend",
                    sentence.alias("performance_sentence"))


_BEST = evq.BEST_SQL[len(evq.METRICS_LONG_SQL):]
_CMP = evq.CMP_SQL[len(evq.METRICS_LONG_SQL):]
_CLIP = "least(greatest({}, 0.0), 1.0)"

RISK_SQL = evq.METRICS_LONG_SQL + _BEST + "," + _CMP + f""",
rate AS (SELECT horizon_hours, model, 100.0 * avg(CAST(beat_persistence AS DOUBLE)) AS beat_rate_pct
         FROM cmp GROUP BY 1, 2),
rc AS (SELECT * RENAME (t AS time) FROM lg WHERE target IS NOT NULL AND fill_ratio IS NOT NULL AND mx24 IS NOT NULL),
ri AS (SELECT *, row_number() OVER (PARTITION BY station_id, horizon_hours ORDER BY time) - 1 AS row_idx,
              count(*) OVER (PARTITION BY station_id, horizon_hours) AS n_rows FROM rc),
rh AS (SELECT *, row_idx >= CAST(floor(n_rows * 0.8) AS BIGINT) AS is_test FROM ri),
tr AS (SELECT station_id, horizon_hours, CASE WHEN target > 0.5 THEN 1 ELSE 0 END AS y,
              {_CLIP.format('mx24')} AS p FROM rh WHERE NOT is_test),
nn AS (SELECT station_id, horizon_hours, count(*) FILTER (WHERE y = 1) AS n_cso,
              count(*) FILTER (WHERE y = 0) AS n_safe FROM tr GROUP BY 1, 2),
tt AS (SELECT rh.station_id, rh.horizon_hours, rh.time, coalesce(b.best_model, 'Persistence') AS model,
              CASE WHEN b.best_model = 'Persistence' THEN {_CLIP.format('fill_ratio')}
                   ELSE {_CLIP.format('mx24')} END AS p
       FROM rh LEFT JOIN best b USING (station_id, horizon_hours) WHERE is_test),
cnt AS (SELECT tt.*,
          (SELECT count(*) FROM tr WHERE tr.station_id = tt.station_id AND tr.horizon_hours = tt.horizon_hours
             AND tr.y = 1 AND 1.0 - tr.p >= 1.0 - tt.p) AS cnt_cso,
          (SELECT count(*) FROM tr WHERE tr.station_id = tt.station_id AND tr.horizon_hours = tt.horizon_hours
             AND tr.y = 0 AND tr.p >= tt.p) AS cnt_safe
        FROM tt),
rka AS (SELECT cnt.*, coalesce(nn.n_cso, 0) AS n_cso, coalesce(nn.n_safe, 0) AS n_safe,
              p * 100.0 AS risk_percent FROM cnt LEFT JOIN nn USING (station_id, horizon_hours)),
rkb AS (SELECT *,
          CASE WHEN n_cso > 0 OR n_safe > 0 THEN (1 + cnt_cso) * 100.0 / (n_cso + 1) END AS p_cso,
          CASE WHEN n_cso > 0 OR n_safe > 0 THEN (1 + cnt_safe) * 100.0 / (n_safe + 1) END AS p_safe
        FROM rka),
rkc AS (SELECT *, greatest(p_cso, p_safe) AS confidence_percent FROM rkb),
prev AS (SELECT station_id, horizon_hours, time + INTERVAL 1 HOUR AS time, risk_percent AS prev_risk FROM rkc)
SELECT r.station_id, r.horizon_hours, r.time, r.model, round(r.risk_percent, 6) AS risk_percent,
       CASE WHEN r.risk_percent < 33.3 THEN 'low' WHEN r.risk_percent < 66.7 THEN 'moderate'
            ELSE 'high' END AS risk_category,
       round(r.p_cso, 6) AS p_cso, round(r.p_safe, 6) AS p_safe,
       round(r.confidence_percent, 6) AS confidence_percent,
       CASE WHEN r.confidence_percent IS NULL THEN NULL WHEN r.confidence_percent < 50 THEN 'low'
            WHEN r.confidence_percent < 80 THEN 'moderate' ELSE 'high' END AS confidence_category,
       CASE WHEN r.p_cso IS NULL THEN NULL WHEN r.p_cso > r.p_safe THEN 'CSO' ELSE 'no CSO' END
         AS confidence_direction,
       CASE WHEN p.prev_risk IS NULL THEN 'stable' WHEN r.risk_percent - p.prev_risk > 1.0 THEN 'rising'
            WHEN r.risk_percent - p.prev_risk < -1.0 THEN 'falling' ELSE 'stable' END AS trend,
       CASE WHEN rate.beat_rate_pct IS NULL
            THEN printf('%s is the persistence baseline at %d h', r.model, r.horizon_hours)
            ELSE printf('%s beat persistence in %.1f%% of comparisons at %d h', r.model,
                        round(rate.beat_rate_pct, 1), r.horizon_hours) END AS performance_sentence
FROM rkc r LEFT JOIN prev p USING (station_id, horizon_hours, time)
LEFT JOIN rate ON rate.horizon_hours = r.horizon_hours AND rate.model = r.model
"""
