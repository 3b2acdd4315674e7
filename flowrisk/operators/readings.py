"""Readings catalogue, candidate choice and incremental merge (E4: S12, F13, P12-P15,
J3, J9, A24, T2, I1, U2, D4).

Per-station choices are grouped aggregations (``min`` / ``min_by``) joined back,
never a window over a whole station, so a station with many measures or many
candidates is still reduced with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the measure catalogue rules:
QUARTER_HOUR = 900
HOURLY = 3600
QUARTER_HOUR_ID_TAG = "-t-900-"
FLAG_COLUMNS = {"flow": "is_flow", "rainfall": "is_rainfall", "groundwater": "is_groundwater"}

ENVELOPE = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("dateTime", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("valueQualifier", T.StringType())])))])


def parse_envelope(df: DataFrame, json_col: str) -> DataFrame:
    """S12 + F13: ``{"items": [...]}`` -> one row per reading (time, value, qualifier)."""
    e = df.select("*", F.explode(F.from_json(F.col(json_col), ENVELOPE)["items"]).alias("_it"))
    return e.select(*[c for c in df.columns if c != json_col],
                    F.to_timestamp("_it.dateTime").alias("time"), F.col("_it.value").alias("value"),
                    F.col("_it.valueQualifier").alias("valueQualifier"))


def measure_priority(period: Column, measure_id: Column) -> Column:
    """0 for 15-minute measures (period 900 or tagged id), 1 for hourly, else NULL."""
    q = (period.cast("string") == str(QUARTER_HOUR)) | F.coalesce(
        measure_id.contains(QUARTER_HOUR_ID_TAG), F.lit(False))
    return F.when(q, F.lit(0)).when(period.cast("string") == str(HOURLY), F.lit(1))


def preferred_measures(measures: DataFrame, station: str, period: str = "period",
                       measure_id: str = "@id") -> DataFrame:
    """Every measure of the best available priority per station (15 min, else
    hourly, else none); ``http://`` ids are upgraded to ``https://``."""
    m = measures.withColumn("_prio", measure_priority(F.col(period), F.col(f"`{measure_id}`")))
    best = m.where(F.col("_prio").isNotNull()).groupBy(station).agg(F.min("_prio").alias("_best"))
    out = m.join(best, station).where(F.col("_prio") == F.col("_best"))
    return out.withColumn(measure_id, F.regexp_replace(F.col(f"`{measure_id}`"), "^http://", "https://")) \
              .drop("_prio", "_best")


def has_quarter_hour(measures: DataFrame, station: str, period: str = "period",
                     measure_id: str = "@id") -> DataFrame:
    """Per station, whether any 15-minute measure exists."""
    return measures.groupBy(station).agg(
        F.bool_or(F.coalesce(measure_priority(F.col(period), F.col(f"`{measure_id}`")) == 0,
                             F.lit(False))).alias("has_15min"))


def station_file_label(label: Column) -> Column:
    """F1: station label -> file prefix (lower case, spaces to underscores)."""
    return F.replace(F.lower(F.coalesce(label, F.lit("station"))), F.lit(" "), F.lit("_"))


def flag_column(kind: str) -> str:
    """Measurement kind -> flag column; an unknown kind raises."""
    try:
        return FLAG_COLUMNS[kind]
    except KeyError:
        raise ValueError(f"unknown measurement kind {kind!r}; expected one of {sorted(FLAG_COLUMNS)}")


def candidate_order(upstream: str = "upstream", distance: str = "distance_m") -> Column:
    """Upstream candidates first, then by distance ascending (as a sortable struct)."""
    return F.struct((~F.col(upstream)).alias("_down"), F.col(distance).alias("_d"))


def candidate_ranks(candidates: DataFrame, target: str, cand: str,
                    upstream: str = "upstream", distance: str = "distance_m",
                    distance_bucket: float = 1000.0) -> DataFrame:
    """1-based order of each candidate within its target (the ordered list as rows).

    Computed with the bucketed ordinal (``cv.ordinal``): candidates are counted per
    (target, upstream flag, distance bucket), offsets are prefix-summed over that small
    table, and only one bucket is ordered at a time; a target with very many
    candidates is therefore never ranked inside a single task.
    """
    from flowrisk.operators.cv import ordinal
    order = F.struct((~F.col(upstream)).alias("_down"), F.col(distance).alias("_d"),
                     F.col(cand).alias("_c"))
    bucket = F.struct((~F.col(upstream)).alias("_down"),
                      F.floor(F.col(distance) / F.lit(distance_bucket)).alias("_db"))
    r = ordinal(candidates.withColumn("_order", order), target, "_order", bucket, "_rk")
    return r.withColumn("candidate_rank", (F.col("_rk") + 1).cast("int")) \
            .drop("_order", "_rk", "n_rows")


def first_with_data(candidates: DataFrame, available: DataFrame, target: str, cand: str,
                    upstream: str = "upstream", distance: str = "distance_m") -> DataFrame:
    """Per target, the first candidate (T2 order) that has data; ``available`` has
    one column ``cand``.  Grouped ``min_by`` instead of a per-target loop."""
    c = candidates.join(available, cand, "left_semi")
    key = F.struct(candidate_order(upstream, distance).alias("order"), F.col(cand))
    return c.groupBy(target).agg(F.min_by(cand, key).alias("chosen"),
                                 F.count(F.lit(1)).alias("n_with_data"))


def incremental_upsert(history: DataFrame, batch: DataFrame, keys, time: str,
                       arrival: str = "_arrival") -> DataFrame:
    """I1 + U2 + D4: rows of ``batch`` newer than the stored maximum of their key are
    appended; then one row per (key, time) is kept, the latest arrival winning (rows that
    arrive together: the one with the largest values, so that the result is fixed)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    last = history.groupBy(*keys).agg(F.max(time).alias("_last"))
    fresh = batch.join(last, keys, "left").where(
        F.col("_last").isNull() | (F.col(time) > F.col("_last"))).drop("_last")
    u = history.withColumn(arrival, F.lit(0)).unionByName(fresh.withColumn(arrival, F.lit(1)))
    others = [c for c in u.columns if c not in keys and c not in (time, arrival)]
    g = u.groupBy(*keys, time).agg(F.max(F.struct(arrival, *others)).alias("_r"))
    return g.select(*keys, time, *[F.col("_r." + c).alias(c) for c in others])
