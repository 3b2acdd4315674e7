"""Regular time grids for keyed series, duplicate handling, exogenous joins.

Survey ids: A2 (bounds), A3 (drop duplicated times), D2 (keep first), D4 (keep last),
P3 (non-negative), J1 (exogenous left join), J2 (reindex to full grid), T1.

The grid is produced directly in *halo layout* (see ``halo.py``): every grid row is
tagged with the time bucket(s) that need it, so the later window stage partitions by
``(key, bucket)`` instead of by ``key`` alone.  A single entity holding a third of all
rows is therefore split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.operators.halo import HaloSpec, bucket_copies
from flowrisk.session import spread, stage

RN = "rn"          # 0-based ordinal on the regular grid
BUCKET = "_bucket"  # time bucket of the halo layout
CORE = "_core"      # row belongs to its own bucket (not a halo copy)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def series_bounds(df: DataFrame, keys, time: str) -> DataFrame:
    """A2: first/last time and row count per key (partial aggregation, tiny output)."""
    keys = _keys(keys)
    return df.groupBy(*keys).agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"),
                                 F.count(F.lit(1)).alias("n_obs"))


def drop_duplicated_times(df: DataFrame, keys, time: str) -> DataFrame:
    """A3: remove *every* row whose (key, time) occurs more than once (``keep=False``)."""
    keys = _keys(keys)
    others = [c for c in df.columns if c not in keys and c != time]
    g = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_dup_n"),
                                    *[F.first(c).alias(c) for c in others])
    return g.where(F.col("_dup_n") == 1).select(*df.columns)


def keep_first_per_time(df: DataFrame, keys, time: str, order: str | Column) -> DataFrame:
    """One row per (key, time), the one with the smallest ``order`` (deterministic)."""
    return _keep_by(df, keys, time, order, F.min_by)


def keep_last_per_time(df: DataFrame, keys, time: str, order: str | Column) -> DataFrame:
    """One row per (key, time), the one with the largest ``order`` (latest arrival)."""
    return _keep_by(df, keys, time, order, F.max_by)


def _keep_by(df, keys, time, order, pick):
    keys = _keys(keys)
    others = [c for c in df.columns if c not in keys and c != time]
    o = F.col(order) if isinstance(order, str) else order
    g = df.groupBy(*keys, time).agg(pick(F.struct(*others), o).alias("_row"))
    return g.select(*keys, time, *[F.col("_row." + c).alias(c) for c in others])


def non_negative(df: DataFrame, column: str) -> DataFrame:
    """Keep rows with ``column >= 0``; NULL and NaN fail like pandas ``ge(0)``."""
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0))


def regular_grid(obs: DataFrame, keys, time: str, step_seconds: int,
                 halo: HaloSpec | None = None, value_cols: Sequence[str] | None = None,
                 bounds: DataFrame | None = None) -> DataFrame:
    """Reindex every key's series onto ``t_min + k*step`` for k in [0, n).

    Observations that do not fall on the grid are dropped (exact-time semantics of a
    pandas ``reindex``).  Grid points without an observation carry NULL values.

    Output columns: keys, ``rn``, ``time``, values, ``_bucket``, ``_core``.  The frame is
    hash-partitioned by (keys, ``_bucket``) and each bucket copy carries the halo rows
    that the window stage needs (``halo``).  The bounds are staged and the grid's rows counted
    from them, so that the number of partitions grows with the grid.
    """
    keys = _keys(keys)
    halo = halo or HaloSpec()
    value_cols = list(value_cols) if value_cols is not None else [
        c for c in obs.columns if c not in keys and c != time]
    if bounds is None:
        bounds = series_bounds(obs, keys, time)
    step = F.lit(step_seconds)
    b = bounds.select(*keys, F.col("t_min").alias("_t0"),
                      ((F.unix_timestamp(F.col("t_max").cast("timestamp"))
                        - F.unix_timestamp(F.col("t_min").cast("timestamp"))) / step)
                      .cast("long").alias("_last"))
    b = stage(b, "bounds")
    B = halo.bucket_rows
    copies = F.floor(F.col("_last") / F.lit(B)) * F.lit(halo.lookback + halo.lookahead)
    n_rows = b.agg(F.sum(F.col("_last") + 1 + copies)).first()[0] or 0

    # observations -> (rn, bucket copies)
    o = (obs.select(*keys, time, *value_cols).join(b, keys)
         .withColumn("_off", F.unix_timestamp(F.col(time).cast("timestamp"))
                     - F.unix_timestamp(F.col("_t0").cast("timestamp"))))
    o = o.where((F.col("_off") % step) == 0).withColumn(RN, (F.col("_off") / step).cast("long"))
    o = bucket_copies(o, RN, "_last", halo).select(*keys, "_t0", BUCKET, RN, *value_cols)

    # grid rows: one row per (key, bucket) first, spread by a small shuffle, then expanded into
    # the bucket's rn range (core plus halo), each task into the rows of one partition below.
    nb = F.floor(F.col("_last") / F.lit(B)).cast("long")
    g = b.select(*keys, "_t0", "_last", F.explode(F.sequence(F.lit(0).cast("long"), nb)).alias(BUCKET))
    g = spread(g, n_rows, *keys, BUCKET)
    lo = F.greatest(F.col(BUCKET) * B - halo.lookback, F.lit(0).cast("long"))
    hi = F.least((F.col(BUCKET) + 1) * B + halo.lookahead - 1, F.col("_last"))
    g = g.select(*keys, "_t0", BUCKET, F.explode(F.sequence(lo, hi)).alias(RN))
    g = g.select("*", *[F.lit(None).cast(dt).alias(c)
                        for c, dt in obs.select(*value_cols).dtypes])

    # the union is merged by a grouped "first non-null" that runs on the
    # (keys, bucket) partitioning; _t0 rides along as a functionally dependent key.
    merged = spread(g.unionByName(o), n_rows, *keys, BUCKET)
    merged = merged.groupBy(*keys, "_t0", BUCKET, RN).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in value_cols])
    t = (F.col("_t0").cast("timestamp")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(RN) * step)
         ).cast(obs.schema[time].dataType)
    return merged.select(*keys, RN, t.alias(time), *value_cols, BUCKET,
                         (F.floor(F.col(RN) / F.lit(B)) == F.col(BUCKET)).alias(CORE))


def core_rows(df: DataFrame) -> DataFrame:
    """Keep each grid row once (its own bucket) and drop the layout columns."""
    return df.where(F.col(CORE)).drop(BUCKET, CORE)


def join_exogenous(panel: DataFrame, exo: DataFrame, time: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Left equi-join of an exogenous series on exact time (and optional keys).

    ``exo`` must already be one row per time (D2).  Whether the right side is
    broadcast is left to the planner/AQE, which checks its measured size against
    ``spark.sql.autoBroadcastJoinThreshold``; beyond it the join shuffles.
    """
    on = list(keys) + [time]
    return panel.join(exo, on, "left")


def latest_rows(df: DataFrame, keys, time: str) -> DataFrame:
    """The latest row of every group (grouped ``max_by``, partial
    aggregation; no window over a whole group)."""
    keys = _keys(keys)
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(time)).alias("_r"))
    return g.select(*keys, *[F.col("_r." + c).alias(c) for c in others])


def only_entity(df: DataFrame, key: str, value) -> DataFrame:
    """Restrict to one entity on request (pushed to the scan as a filter)."""
    return df if value is None else df.where(F.col(key) == F.lit(value))
