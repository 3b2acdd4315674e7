"""Event-load panels built from the ``events`` table (entity = event_type).

The hourly load of each event type plays the role of a monitored series: it is put
on a regular grid (J2), normalised by its capacity (P7), and fed to the window
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import rnd, safe_div
from flowrisk.operators.grid import regular_grid
from flowrisk.operators.halo import HaloSpec
from flowrisk.operators.windows import Feat, compute_features, halo_of
from flowrisk.plans.event_features import stretched
from flowrisk.sources.tables import table

KEY = "event_type"
TIME = "time"


def hourly_load(spark: SparkSession, sf_dir: str, stretch: int = 1) -> DataFrame:
    ev = stretched(table(spark, sf_dir, "events"), stretch)
    return (ev.groupBy(KEY, F.date_trunc("hour", "ts").alias(TIME))
            .agg((F.sum(F.round(F.col("value") * 100)) / F.lit(100.0)).alias("load"),
                 F.count(F.lit(1)).alias("n_events")))


def capacity(load: DataFrame) -> DataFrame:
    """Dimension analogue of pipe diameter: the largest hourly load per type."""
    return load.groupBy(KEY).agg(F.max("load").alias("capacity"))


def fill_panel(spark: SparkSession, sf_dir: str, feats: list[Feat],
               bucket_rows: int = 1 << 16, fit: bool = True, stretch: int = 1,
               empty: float | None = None) -> DataFrame:
    """The hourly panel with ``feats``.  ``stretch`` lengthens the event history; ``empty`` is
    the load of an hour without events (unknown unless given)."""
    load = hourly_load(spark, sf_dir, stretch)
    lb, la = halo_of(feats)
    halo = HaloSpec(bucket_rows, lb, la)
    halo = halo.fitted() if fit else halo
    g = regular_grid(load.select(KEY, TIME, "load"), KEY, TIME, 3600, halo)
    if empty is not None:
        g = g.fillna(empty, ["load"])
    g = g.join(capacity(load), KEY).withColumn(
        "fill_ratio", safe_div(F.col("load"), F.col("capacity")))
    return compute_features(g.drop("capacity"), KEY, feats, step_hours=1.0)


def exceedance_rate(spark: SparkSession, sf_dir: str, threshold: float = 0.5,
                    horizon_rows: int = 6, window_rows: int = 24,
                    bucket_rows: int = 1 << 16) -> DataFrame:
    """Stage-0 slice: grid -> trailing max -> next-H target -> exceedance rate per type."""
    feats = [Feat("max_24", "trail_max", "fill_ratio", window_rows),
             Feat("target", "next_max", "fill_ratio", horizon_rows)]
    p = fill_panel(spark, sf_dir, feats, bucket_rows)
    y = (F.col("target") > F.lit(threshold)).cast("int")
    return p.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("fill_ratio").alias("n_obs"),
        F.count("target").alias("n_target"),
        F.sum(y).cast("long").alias("n_exceed"),
        rnd(F.avg(y)).alias("event_rate"),
        rnd(F.avg("max_24")).alias("mean_max_24"),
    )


EXCEEDANCE_RATE_SQL = """
WITH hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS t, sum(round(value * 100)) / 100.0 AS load
  FROM events GROUP BY 1, 2),
cap AS (SELECT event_type, max(load) AS capacity, min(t) AS t0, max(t) AS t1
        FROM hourly GROUP BY 1),
grid AS (SELECT event_type, capacity, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t
         FROM cap),
panel AS (
  SELECT g.event_type, g.t, h.load / g.capacity AS fill_ratio
  FROM grid g LEFT JOIN hourly h ON h.event_type = g.event_type AND h.t = g.t),
feat AS (
  SELECT event_type, fill_ratio,
    CASE WHEN count(fill_ratio) OVER (PARTITION BY event_type ORDER BY t
              ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
         THEN max(fill_ratio) OVER (PARTITION BY event_type ORDER BY t
              ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS max_24,
    CASE WHEN count(fill_ratio) OVER (PARTITION BY event_type ORDER BY t
              ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) = 6
         THEN max(fill_ratio) OVER (PARTITION BY event_type ORDER BY t
              ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) END AS target
  FROM panel)
SELECT event_type,
       count(*) AS n_rows,
       count(fill_ratio) AS n_obs,
       count(target) AS n_target,
       CAST(sum(CASE WHEN target > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_exceed,
       round(avg(CASE WHEN target > 0.5 THEN 1 ELSE 0 END)
             FILTER (WHERE target IS NOT NULL), 6) AS event_rate,
       round(avg(max_24), 6) AS mean_max_24
FROM feat GROUP BY 1
"""
