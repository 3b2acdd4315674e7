"""Scored binary outcomes from the driver tables and their quality metrics.

* documents/labels: outcome ``quality``, score ``n_chars / (n_chars + 2000)``, group ``lang``
* events: outcome ``event_type = 'error'``, score ``least(value / 500, 1)``, group = day
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import rnd
from flowrisk.operators.metrics import binary_metrics, decide
from flowrisk.sources.tables import table

RATIO_COLS = ("MAE", "MSE", "Brier", "Precision", "Recall", "F1", "Specificity", "ROC_AUC",
              "PR_AUC")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    p = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    return (lab.join(doc, "doc_id")
            .select(F.col("lang").alias("grp"), "y", p.alias("p"))
            .withColumn("pred", decide("p", 0.5)))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    p = F.least(F.col("value") / F.lit(500.0), F.lit(1.0))
    return ev.select(F.to_date("ts").alias("grp"),
                     (F.col("event_type") == "error").cast("int").alias("y"),
                     p.alias("p")).withColumn("pred", decide("p", 0.2))


def metrics_of(scored: DataFrame) -> DataFrame:
    m = binary_metrics(scored, "grp")
    return m.select("grp", "n", "tp", "fp", "fn", "tn", *[rnd(c).alias(c) for c in RATIO_COLS])


def _metrics_sql(scored_sql: str) -> str:
    return f"""
WITH s AS ({scored_sql}),
base AS (
  SELECT grp, count(*) AS n,
         avg(abs(p - y)) AS MAE, avg((p - y) * (p - y)) AS MSE, avg((p - y) * (p - y)) AS Brier,
         count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
         count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
         count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn
  FROM s GROUP BY grp),
pairs AS (  -- Mann-Whitney by explicit positive x negative pairs
  SELECT a.grp, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS wins
  FROM s a JOIN s b ON a.grp = b.grp AND a.y = 1 AND b.y = 0 GROUP BY a.grp),
thr AS (    -- precision / recall at each distinct positive score
  SELECT t.grp, t.p, t.npos_at,
         (SELECT count(*) FROM s x WHERE x.grp = t.grp AND x.p >= t.p AND x.y = 1) AS tp_at,
         (SELECT count(*) FROM s x WHERE x.grp = t.grp AND x.p >= t.p) AS all_at
  FROM (SELECT grp, p, count(*) AS npos_at FROM s WHERE y = 1 GROUP BY grp, p) t),
ap AS (
  SELECT thr.grp, sum(npos_at * tp_at / all_at) AS num FROM thr GROUP BY thr.grp)
SELECT b.grp, b.n, b.tp, b.fp, b.fn, b.tn,
       round(b.MAE, 6) AS MAE, round(b.MSE, 6) AS MSE, round(b.Brier, 6) AS Brier,
       round(CASE WHEN b.tp + b.fp = 0 THEN 0 ELSE b.tp / (b.tp + b.fp) END, 6) AS Precision,
       round(CASE WHEN b.tp + b.fn = 0 THEN 0 ELSE b.tp / (b.tp + b.fn) END, 6) AS Recall,
       round(CASE WHEN 2 * b.tp + b.fp + b.fn = 0 THEN 0
                  ELSE 2 * b.tp / (2 * b.tp + b.fp + b.fn) END, 6) AS F1,
       round(CASE WHEN b.tn + b.fp = 0 THEN NULL ELSE b.tn / (b.tn + b.fp) END, 6) AS Specificity,
       round(CASE WHEN (b.tp + b.fn) > 0 AND (b.tn + b.fp) > 0
                  THEN pairs.wins / ((b.tp + b.fn) * (b.tn + b.fp)) END, 6) AS ROC_AUC,
       round(CASE WHEN (b.tp + b.fn) = 0 THEN 0.0 ELSE coalesce(ap.num, 0) / (b.tp + b.fn) END, 6)
         AS PR_AUC
FROM base b LEFT JOIN pairs ON pairs.grp = b.grp LEFT JOIN ap ON ap.grp = b.grp
"""


LABEL_METRICS_SQL = _metrics_sql(
    "SELECT d.lang AS grp, l.quality AS y, d.n_chars / (d.n_chars + 2000.0) AS p, "
    "CASE WHEN d.n_chars / (d.n_chars + 2000.0) >= 0.5 THEN 1 ELSE 0 END AS pred "
    "FROM labels l JOIN documents d ON d.doc_id = l.doc_id")

EVENT_METRICS_SQL = _metrics_sql(
    "SELECT CAST(ts AS DATE) AS grp, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, "
    "least(value / 500.0, 1.0) AS p, "
    "CASE WHEN least(value / 500.0, 1.0) >= 0.2 THEN 1 ELSE 0 END AS pred FROM events")
