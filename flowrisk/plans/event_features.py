"""Full feature catalogue on a 10-minute event panel (entity = event_type).

Analogue mapping (``events`` table):

* depth   <- load in cents per slot (zero when no event: absence means no load)
* flow    <- number of events per slot (zero when none)
* velocity<- mean event value per slot (NULL when no event)
* fill    <- depth / capacity, capacity = largest slot load of the type (P7)
* forecast precipitation <- hourly value total of ``error`` events; its z-score (A1)
  cumulated over time (W16) gives the ``_cum`` series
* rain readings <- 30-minute mean value of ``signup`` events
* groundwater readings <- 2-hour mean of the JSON property ``k`` (F13)

Exogenous series are joined on exact time (J1), so only on-grid readings land, then
interior gaps are filled up to a limit (W17) before the windows run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import attach_scalars, col, rnd, safe_div
from flowrisk.operators.features import Cols, calendar, catalogue, feature_names
from flowrisk.operators.gapfill import fill_gaps
from flowrisk.operators.grid import (core_rows, drop_duplicated_times, non_negative,
                                     regular_grid)
from flowrisk.operators.halo import HaloSpec
from flowrisk.operators.windows import Feat, compute_features, halo_of, rows
from flowrisk.plans.sqlgen import calendar_sql, feature_sql
from flowrisk.session import stage
from flowrisk.sources.tables import table

KEY = "event_type"
FREQ_MIN = 10
STEP_S = FREQ_MIN * 60
HORIZON_H = 6
GAP_LIMIT = rows(24 * 7, FREQ_MIN)
C = Cols()
STRETCH_FROM = "2024-01-01 00:00:00"


def _slot(col: str, seconds: int):
    ts = F.col(col).cast("timestamp")
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds).cast(
        "timestamp_ntz")


def cents_avg(c) -> F.Column:
    """Mean of a 2-decimal amount computed on exact integer cents (order independent)."""
    return F.sum(F.round(F.col(c) * 100)) / (F.count(F.col(c)) * F.lit(100.0))


def flow_obs(ev: DataFrame) -> DataFrame:
    obs = ev.groupBy(KEY, _slot("ts", STEP_S).alias("time")).agg(
        F.sum(F.round(F.col("value") * 100)).cast("long").alias(C.depth),
        F.count(F.lit(1)).cast("long").alias(C.flow),
        cents_avg("value").alias(C.velocity))
    obs = drop_duplicated_times(obs, KEY, "time")          # A3 (before the >= 0 filter)
    return non_negative(obs, C.depth)                        # P3


def forecast_series(spark: SparkSession, ev: DataFrame, bucket_rows: int) -> DataFrame:
    """Hourly error counts, z-scored with the global mean / sample std, then cumulated."""
    f = (ev.where(F.col(KEY) == "error")
         .groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("time"))
         .agg((F.sum(F.round(F.col("value") * 100)) / F.lit(100.0)).alias(C.precip)))
    stats = f.agg(F.avg(C.precip).alias("_mu"), F.stddev_samp(C.precip).alias("_sd"))
    z = attach_scalars(f, stats).withColumn(
        "_z", safe_div(F.col(C.precip) - F.col("_mu"), F.col("_sd"))).select(
        F.lit("all").alias("_series"), "time", C.precip, "_z")
    lay = regular_grid(z, "_series", "time", 3600, HaloSpec(bucket_rows).fitted())
    cum = compute_features(lay, "_series", [Feat(C.precip_cum, "cumsum", "_z")], 1.0)
    return cum.where(F.col(C.precip).isNotNull()).select("time", C.precip, C.precip_cum)


def readings(ev: DataFrame, value: F.Column, seconds: int, name: str,
             where=None) -> DataFrame:
    src = ev if where is None else ev.where(where)
    return src.groupBy(_slot("ts", seconds).alias("time")).agg(value.alias(name))


def stretched(ev: DataFrame, factor: int) -> DataFrame:
    """Events with the time since ``STRETCH_FROM`` multiplied, for long windows on a short table."""
    if factor == 1:
        return ev
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit(STRETCH_FROM).cast("timestamp"))
    return ev.withColumn("ts", F.timestamp_micros(start + (micros - start) * factor).cast("timestamp_ntz"))


#: Features that look at the horizon; all others are the same for every horizon.
OF_HORIZON = ("fill_ratio_target", "rainfall_sum_horizon", "rainfall_max_horizon", "is_raining",
              *(f.name for f in calendar(C.time, HORIZON_H)))


def horizon_catalogue(horizons: Sequence[float]) -> list[Feat]:
    """The catalogue with one column for each horizon (``name__H``) of the features that look at it."""
    feats = [f for f in catalogue(horizons[0], FREQ_MIN, c=C) if f.name not in OF_HORIZON]
    for h in horizons:
        for f in catalogue(h, FREQ_MIN, c=C):
            if f.name in OF_HORIZON:
                source = f"{f.col}__{h}" if f.col in OF_HORIZON else f.col
                feats.append(replace(f, name=f"{f.name}__{h}", col=source))
    return feats


def panel(spark: SparkSession, sf_dir: str, horizon_hours: float = HORIZON_H,
          bucket_rows: int = 1 << 16, fit: bool = True, stretch: int = 1,
          dry: bool = False, feats: list[Feat] | None = None) -> tuple[DataFrame, list[Feat]]:
    """The 10-minute panel with all features (``feats``: others than one horizon's catalogue).  ``stretch`` lengthens the event history;
    ``dry`` adds a dry-weather flow of 1 to every slot and a velocity of 0 to those without
    events, so that complete rows exist wherever the windows are full."""
    ev = stretched(table(spark, sf_dir, "events").select("ts", KEY, "value", "props"), stretch)
    feats = feats or catalogue(horizon_hours, FREQ_MIN, c=C)
    lb, la = halo_of(feats)
    halo = HaloSpec(bucket_rows, lb, la)
    halo = halo.fitted() if fit else halo
    obs = flow_obs(ev)
    lay = regular_grid(obs, KEY, "time", STEP_S, halo)
    lay = lay.withColumns({C.depth: F.coalesce(C.depth, F.lit(0)).cast("long"),
                           C.flow: F.coalesce(C.flow, F.lit(0)).cast("long")})
    if dry:
        lay = lay.withColumns({C.velocity: F.coalesce(C.velocity, F.lit(0.0)), C.flow: F.col(C.flow) + 1})
    cap = obs.groupBy(KEY).agg(F.max(C.depth).alias("_cap"))
    # one global series (bounded by the time span): staged so its own grid / cumsum
    # sub-plan is not repeated inside every branch of the panel plan
    fc = stage(forecast_series(spark, ev, bucket_rows), "forecast")
    rain = readings(ev, cents_avg("value"), 1800, C.rain, F.col(KEY) == "signup")
    grnd = readings(ev, F.avg(F.get_json_object("props", "$.k").cast("double")), 7200, C.grnd)
    lay = (lay.join(cap, KEY).withColumn(C.fill, safe_div(F.col(C.depth), F.col("_cap")))
           .drop("_cap")
           .join(fc, "time", "left").join(rain, "time", "left").join(grnd, "time", "left"))
    # the layout and the filled layout are each read twice (rows and bucket summaries)
    lay = fill_gaps(stage(lay, "layout"), KEY, [C.precip, C.precip_cum, C.rain, C.grnd], GAP_LIMIT, halo)
    lay = stage(lay, "filled")
    keep = [KEY, "rn", "time", C.depth, C.flow, C.velocity, C.fill, C.precip,
            C.precip_cum, C.rain, C.grnd]
    return compute_features(lay, KEY, feats, FREQ_MIN / 60.0, keep=keep), feats


#: Variances and products are large numbers whose last digits depend on the order of
#: summation: they are checked as whole numbers, away from the ties of short decimals.
WHOLE, OFF_TIES = ("trail_var", "fwd_var", "product"), 0.1234


def _digits(f: Feat) -> int:
    return {"trail_std": 4}.get(f.op, 6)


def feature_table(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Every grid row with target and all catalogue features (rounded for hashing)."""
    p, feats = panel(spark, sf_dir, **kw)
    base = [KEY, "time", C.depth, C.flow]
    dbl = [C.velocity, C.fill, C.precip, C.precip_cum, C.rain, C.grnd]
    out = [F.col(c) for c in base] + [rnd(c, 6).alias(c) for c in dbl]
    seen = set()
    for f in feats:
        if f.name in seen:
            continue
        seen.add(f.name)
        if f.op in ("flag_gt", "gt_quantile") or f.name == "day_of_week":
            out.append(col(f.name).cast("int").alias(f.name))
        elif f.op in WHOLE:
            out.append(F.round(col(f.name) + F.lit(OFF_TIES), 0).alias(f.name))
        else:
            out.append(rnd(f.name, _digits(f)).alias(f.name))
    return p.select(*out)


def feature_summary(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Per-entity counts of non-null features and target exceedance (compact check)."""
    p, feats = panel(spark, sf_dir, **kw)
    names = feature_names(feats)
    y = (F.col("fill_ratio_target") > F.lit(0.95)).cast("int")
    return p.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.count("fill_ratio_target").alias("n_target"),
                              F.sum(y).cast("long").alias("n_exceed"),
                              *[F.count(col(n)).alias(f"nn_{n}") for n in names])


# ----------------------------------------------------------------------------- oracle
def _oracle_panel_sql(horizon_hours: float = HORIZON_H, stretch: int = 1,
                      dry: bool = False) -> tuple[str, list[Feat]]:
    feats = catalogue(horizon_hours, FREQ_MIN, c=C)
    step_h = FREQ_MIN / 60.0
    layer1 = [f for f in feats if f.op not in ("product", "flag_gt", "expr")]
    layer2 = [f for f in feats if f.op in ("product", "flag_gt", "expr")]
    cal = calendar_sql("time", horizon_hours)
    seen, l1, l2 = set(), [], []
    for f in layer1:
        if f.name not in seen:
            seen.add(f.name)
            l1.append(f'{feature_sql(f, KEY, "rn", step_h)} AS "{f.name}"')
    for f in layer2:
        if f.name not in seen:
            seen.add(f.name)
            src = f.col if f.op != "expr" else None
            l2.append(f'{feature_sql(f, KEY, "rn", step_h, cal)} AS "{f.name}"')
            del src
    gap = GAP_LIMIT
    fills = []
    for c in (C.precip, C.precip_cum, C.rain, C.grnd):
        p = (f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'r': rn, 'v': {c}}} END IGNORE NULLS)"
             f" OVER (PARTITION BY {KEY} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        n = (f"first_value(CASE WHEN {c} IS NOT NULL THEN {{'r': rn, 'v': {c}}} END IGNORE NULLS)"
             f" OVER (PARTITION BY {KEY} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
        fills.append(f"{p} AS _p_{c}, {n} AS _n_{c}")
    fixed = []
    for c in (C.precip, C.precip_cum, C.rain, C.grnd):
        fixed.append(
            f"CASE WHEN {c} IS NULL AND _p_{c} IS NOT NULL AND _n_{c} IS NOT NULL "
            f"AND rn - _p_{c}.r <= {gap} THEN _p_{c}.v + (_n_{c}.v - _p_{c}.v) * "
            f"(rn - _p_{c}.r) / (_n_{c}.r - _p_{c}.r) ELSE {c} END AS {c}")
    velocity = "coalesce(o.velocity_m_s, 0.0)" if dry else "o.velocity_m_s"
    sql = f"""
WITH ev AS (SELECT TIMESTAMP '{STRETCH_FROM}' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '{STRETCH_FROM}'))
                   * {stretch}) AS ts, event_type, value, props FROM events),
obs0 AS (
  SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS time,
         CAST(sum(round(value * 100)) AS BIGINT) AS depth_mm,
         count(*) AS flow_l_s, sum(round(value * 100)) / (count(value) * 100.0) AS velocity_m_s
  FROM ev GROUP BY 1, 2),
obs AS (SELECT * FROM obs0 WHERE depth_mm >= 0),
bounds AS (SELECT event_type, min(time) AS t0, max(time) AS t1, max(depth_mm) AS cap
           FROM obs GROUP BY 1),
grid AS (SELECT event_type, cap, t0, unnest(generate_series(t0, t1, INTERVAL 10 MINUTE)) AS time
         FROM bounds),
fc0 AS (SELECT date_trunc('hour', ts) AS time, sum(round(value * 100)) / 100.0 AS precipitation_surface
        FROM ev WHERE event_type = 'error' GROUP BY 1),
fcs AS (SELECT avg(precipitation_surface) AS mu, stddev_samp(precipitation_surface) AS sd FROM fc0),
fc AS (SELECT time, precipitation_surface,
              sum((precipitation_surface - mu) / sd) OVER (ORDER BY time
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS precipitation_surface_cum
       FROM fc0, fcs),
rain AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS time,
                sum(round(value * 100)) / (count(value) * 100.0) AS rain_hde
         FROM ev WHERE event_type = 'signup' GROUP BY 1),
grnd AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS time,
                avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS grnd_hde
         FROM ev GROUP BY 1),
p0 AS (
  SELECT g.event_type, g.time,
         CAST(epoch(g.time - g.t0) / {STEP_S} AS BIGINT) AS rn,
         coalesce(o.depth_mm, 0) AS depth_mm, coalesce(o.flow_l_s, 0) + {int(dry)} AS flow_l_s,
         {velocity} AS velocity_m_s, coalesce(o.depth_mm, 0) / g.cap AS fill_ratio,
         fc.precipitation_surface, fc.precipitation_surface_cum, rain.rain_hde, grnd.grnd_hde
  FROM grid g
  LEFT JOIN obs o ON o.event_type = g.event_type AND o.time = g.time
  LEFT JOIN fc ON fc.time = g.time
  LEFT JOIN rain ON rain.time = g.time
  LEFT JOIN grnd ON grnd.time = g.time),
p1 AS (SELECT *, {", ".join(fills)} FROM p0),
p AS (SELECT event_type, time, rn, depth_mm, flow_l_s, velocity_m_s, fill_ratio,
             {", ".join(fixed)} FROM p1),
f1 AS (SELECT *, {", ".join(l1)} FROM p),
f2 AS (SELECT *, {", ".join(l2)} FROM f1)
"""
    return sql, feats


def feature_table_sql() -> str:
    sql, feats = _oracle_panel_sql()
    base = [KEY, "time", C.depth, C.flow]
    dbl = [C.velocity, C.fill, C.precip, C.precip_cum, C.rain, C.grnd]
    out = list(base) + [f"round({c}, 6) AS {c}" for c in dbl]
    seen = set()
    for f in feats:
        if f.name in seen:
            continue
        seen.add(f.name)
        if f.op in ("flag_gt", "gt_quantile") or f.name == "day_of_week":
            out.append(f'CAST("{f.name}" AS INTEGER) AS "{f.name}"')
        elif f.op in WHOLE:
            out.append(f'round(CAST("{f.name}" AS DOUBLE) + {OFF_TIES}, 0) AS "{f.name}"')
        else:
            out.append(f'round(CAST("{f.name}" AS DOUBLE), {_digits(f)}) AS "{f.name}"')
    return sql + "SELECT " + ", ".join(out) + " FROM f2"


def feature_summary_sql() -> str:
    sql, feats = _oracle_panel_sql()
    names = feature_names(feats)
    cnt = ", ".join(f'count("{n}") AS "nn_{n}"' for n in names)
    return (sql + f"SELECT {KEY}, count(*) AS n_rows, count(fill_ratio_target) AS n_target, "
            f"CAST(sum(CASE WHEN fill_ratio_target > 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_exceed, "
            f"{cnt} FROM f2 GROUP BY {KEY}")


__all__ = ["panel", "feature_table", "feature_summary", "feature_table_sql",
           "feature_summary_sql", "calendar", "core_rows"]
