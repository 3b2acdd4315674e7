"""Long-window panel: daily shipped quantity per supplier from ``lineitem``.

Entities are suppliers (their number grows with the scale factor), the grid is daily
(J2) and days without shipments carry zero quantity.  Windows reach 365 rows, so the
prefix-sum / doubling-table formulations and the halo buckets are exercised at a
realistic ratio of window to series length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import col, rnd
from flowrisk.operators.grid import regular_grid
from flowrisk.operators.halo import HaloSpec
from flowrisk.operators.windows import Feat, compute_features, halo_of
from flowrisk.plans.sqlgen import feature_sql
from flowrisk.session import spread, stage
from flowrisk.sources.tables import table

KEY = "l_suppkey"

FEATS = [
    Feat("qty_sum_7d", "trail_sum", "qty", 7),
    Feat("qty_sum_30d", "trail_sum", "qty", 30),
    Feat("qty_sum_365d", "trail_sum", "qty", 365),
    Feat("qty_mean_90d", "trail_mean", "qty", 90),
    Feat("qty_std_90d", "trail_std", "qty", 90),
    Feat("qty_max_30d", "trail_max", "qty", 30),
    Feat("qty_max_365d", "trail_max", "qty", 365),
    Feat("lines_min_7d", "trail_min", "lines", 7),
    Feat("qty_next_30d", "fwd_sum", "qty", 30),
    Feat("qty_next_max_7d", "next_max", "qty", 7),
    Feat("qty_lag_365d", "lag", "qty", 365),
    Feat("days_since_big", "hours_since", "qty", thr=100.0),
    Feat("cum_qty", "cumsum", "qty"),
    Feat("busy_days_30d", "count_above", "lines", 30, thr=0.0),
]
ROUNDED = {"qty_mean_90d", "qty_std_90d"}


def panel(spark: SparkSession, sf_dir: str, bucket_rows: int = 1 << 16,
          fit: bool = True) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    li = spread(li.select(KEY, F.col("l_shipdate").alias("day"), "l_quantity"), li.count(), KEY, "day")
    obs = stage(li.groupBy(KEY, "day").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines")),
                "daily")                  # read three times: bounds, grid, carried summaries
    lb, la = halo_of(FEATS)
    halo = HaloSpec(bucket_rows, lb, la)
    halo = halo.fitted() if fit else halo
    g = regular_grid(obs, KEY, "day", 86400, halo)
    g = g.withColumn("qty", F.coalesce("qty", F.lit(0.0))) \
         .withColumn("lines", F.coalesce("lines", F.lit(0)).cast("long"))
    return compute_features(g, KEY, FEATS, step_hours=1.0)


def long_window_table(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    p = panel(spark, sf_dir, **kw)
    out = [KEY, "day", "qty", "lines"]
    for f in FEATS:
        out.append(rnd(f.name, 6).alias(f.name) if f.name in ROUNDED else col(f.name))
    return p.select(*out)


def _sql() -> str:
    l1 = ", ".join(f'{feature_sql(f, KEY, "rn", 1.0)} AS "{f.name}"' for f in FEATS)
    sel = ", ".join(f'round({f.name}, 6) AS {f.name}' if f.name in ROUNDED else f.name
                    for f in FEATS)
    return f"""
WITH obs AS (SELECT l_suppkey, l_shipdate AS day, sum(l_quantity) AS qty, count(*) AS lines
             FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey, min(day) AS t0, max(day) AS t1 FROM obs GROUP BY 1),
g AS (SELECT l_suppkey, t0, unnest(generate_series(t0, t1, INTERVAL 1 DAY)) AS day FROM b),
p AS (SELECT g.l_suppkey, g.day, CAST(epoch(g.day - g.t0) / 86400 AS BIGINT) AS rn,
             coalesce(o.qty, 0.0) AS qty, coalesce(o.lines, 0) AS lines
      FROM g LEFT JOIN obs o ON o.l_suppkey = g.l_suppkey AND o.day = g.day),
f AS (SELECT *, {l1} FROM p)
SELECT l_suppkey, day, qty, lines, {sel} FROM f"""


LONG_WINDOW_SQL = _sql()
