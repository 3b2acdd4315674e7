"""Readings sync (E4) on driver tables.

* measure catalogue <- ``orders``: station = customer, period by order status
  (F: 900 s, O: 3600 s, P: daily), ids of ``2-HIGH`` orders carry the 15-minute tag.
* candidates <- ``supplier``: target = nation (those with a supplier whose balance
  exceeds 9000, J3), candidate rain stations = suppliers of the nation with balance
  below 5000, upstream = positive balance, distance = supplier key; data available =
  supplier with shipped lineitems.
* incremental merge <- ``events``: history = events before 2024-01-20, new batch =
  events from 2024-01-15 (overlap); the JSON property ``k`` is the value qualifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import attach_scalars, rnd
from flowrisk.operators import readings as rd
from flowrisk.sources.tables import table


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    period = F.when(F.col("o_orderstatus") == "F", F.lit(900)) \
              .when(F.col("o_orderstatus") == "O", F.lit(3600)).otherwise(F.lit(86400))
    mid = F.concat(F.lit("http://hydrology/measures/"), F.col("o_orderkey").cast("string"),
                   F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("-t-900-")).otherwise(F.lit("-")),
                   F.lit("q"))
    return o.select(F.col("o_custkey").alias("station"), mid.alias("@id"), period.alias("period"))


def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measures(spark, sf_dir)
    p = rd.preferred_measures(m, "station")
    h = rd.has_quarter_hour(m, "station")
    return p.join(h, "station").select("station", F.col("`@id`").alias("measure_id"), "period",
                                       "has_15min")


def candidates(spark: SparkSession, sf_dir: str, kind: str = "rainfall") -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    c = s.select(F.col("s_nationkey").alias("target"), F.col("s_suppkey").alias("station_id"),
                 (F.col("s_acctbal") >= 0).alias("is_flow"),
                 (F.col("s_acctbal") < 5000).alias("is_rainfall"),
                 F.lit(False).alias("is_groundwater"),
                 F.col("s_suppkey").cast("double").alias("distance_m"),
                 (F.col("s_acctbal") > 0).alias("upstream"),
                 (F.col("s_acctbal") > 9000).alias("_is_target"))
    targets = c.where(F.col("_is_target")).select("target").distinct()     # J3 (semi)
    c = c.join(targets, "target", "left_semi").where(F.col(rd.flag_column(kind)))  # P14
    return c.drop("_is_target")


def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    ranked = rd.candidate_ranks(c, "target", "station_id")                # A24 / T2
    avail = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station_id")).distinct()
    first = rd.first_with_data(c, avail, "target", "station_id")          # J9
    n = c.groupBy("target").agg(F.count(F.lit(1)).alias("n_candidates"))
    return first.join(ranked.select("target", F.col("station_id").alias("chosen"), "candidate_rank"),
                      ["target", "chosen"]).join(n, "target")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_type", "ts", "value", F.get_json_object("props", "$.k").alias("valueQualifier"))
    # history: the first two thirds of the time span; batch: its second half
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = attach_scalars(ev.withColumn("_at", at), ev.agg(F.min(at).alias("_t0"), F.max(at).alias("_t1")))
    span = F.col("_t1") - F.col("_t0")
    drop = ["_at", "_t0", "_t1"]
    hist = ev.where((F.col("_at") - F.col("_t0")) * 3 < span * 2).drop(*drop)
    batch = ev.where((F.col("_at") - F.col("_t0")) * 2 >= span).withColumn("value", F.col("value") + 1.0).drop(*drop)
    m = rd.incremental_upsert(hist, batch, "event_type", "ts")
    return m.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"),
                                       rnd(F.sum("value"), 4).alias("value_sum"),
                                       F.count("valueQualifier").alias("n_qualified"))


PREFERRED_SQL = """
WITH m AS (
  SELECT o_custkey AS station,
         'http://hydrology/measures/' || CAST(o_orderkey AS VARCHAR) ||
         CASE WHEN o_orderpriority = '2-HIGH' THEN '-t-900-' ELSE '-' END || 'q' AS mid,
         CASE o_orderstatus WHEN 'F' THEN 900 WHEN 'O' THEN 3600 ELSE 86400 END AS period
  FROM orders),
p AS (SELECT *, CASE WHEN CAST(period AS VARCHAR) = '900' OR contains(mid, '-t-900-') THEN 0
                     WHEN CAST(period AS VARCHAR) = '3600' THEN 1 END AS prio FROM m),
best AS (SELECT station, min(prio) AS b FROM p WHERE prio IS NOT NULL GROUP BY station),
h AS (SELECT station, bool_or(coalesce(prio = 0, false)) AS has_15min FROM p GROUP BY station)
SELECT p.station, regexp_replace(p.mid, '^http://', 'https://') AS measure_id, p.period, h.has_15min
FROM p JOIN best ON best.station = p.station AND p.prio = best.b JOIN h ON h.station = p.station
"""

CANDIDATE_SQL = """
WITH c0 AS (SELECT s_nationkey AS target, s_suppkey AS station_id, s_acctbal < 5000 AS is_rainfall,
                   CAST(s_suppkey AS DOUBLE) AS distance_m, s_acctbal > 0 AS upstream,
                   s_acctbal > 9000 AS is_target FROM supplier),
t AS (SELECT DISTINCT target FROM c0 WHERE is_target),
c AS (SELECT * FROM c0 WHERE target IN (SELECT target FROM t) AND is_rainfall),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY upstream DESC, distance_m, station_id)
                AS candidate_rank FROM c),
a AS (SELECT * FROM r WHERE station_id IN (SELECT l_suppkey FROM lineitem)),
f AS (SELECT target, arg_min(station_id, candidate_rank) AS chosen, count(*) AS n_with_data
      FROM a GROUP BY target),
n AS (SELECT target, count(*) AS n_candidates FROM c GROUP BY target)
SELECT f.target, f.chosen, f.n_with_data, CAST(r.candidate_rank AS INTEGER) AS candidate_rank,
       n.n_candidates
FROM f JOIN r ON r.target = f.target AND r.station_id = f.chosen JOIN n ON n.target = f.target
"""

UPSERT_SQL = """
WITH ev AS (SELECT event_type, ts, value, json_extract_string(props, '$.k') AS valueQualifier FROM events),
span AS (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) - epoch_us(min(ts)) AS d FROM events),
hist AS (SELECT ev.* FROM ev, span WHERE (epoch_us(ts) - t0) * 3 < d * 2),
batch AS (SELECT event_type, ts, value + 1.0 AS value, valueQualifier FROM ev, span
          WHERE (epoch_us(ts) - t0) * 2 >= d),
last AS (SELECT event_type, max(ts) AS l FROM hist GROUP BY 1),
fresh AS (SELECT b.* FROM batch b LEFT JOIN last ON last.event_type = b.event_type
          WHERE last.l IS NULL OR b.ts > last.l),
u AS (SELECT *, 0 AS arrival FROM hist UNION ALL SELECT *, 1 FROM fresh),
k AS (SELECT event_type, ts, arg_max({'v': value, 'q': valueQualifier}, (arrival, value)) AS r
      FROM u GROUP BY 1, 2),
k2 AS (SELECT event_type, ts, r.v AS value, r.q AS valueQualifier FROM k)
SELECT event_type, count(*) AS n, max(ts) AS last_ts, round(sum(value), 4) AS value_sum,
       count(valueQualifier) AS n_qualified
FROM k2 GROUP BY 1
"""
