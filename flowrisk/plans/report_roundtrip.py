"""Round trip for the report parser on driver data.

Spark renders one flow report per (event type, day) from ``events`` in the report
grammar (header with identifier and 12-digit range, 15-character chunks, a junk
chunk opening every even line), then parses the texts back (C1).  The oracle computes
the expected records straight from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.sources.reports import parse_flow, parse_rain
from flowrisk.sources.tables import table

PER_LINE = 6
SLOTS = 144  # 10-minute records per day
JUNK = "x" * 15


def render_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    slot = F.floor((F.unix_seconds(F.col("ts").cast("timestamp"))
                    - F.unix_seconds(F.date_trunc("day", F.col("ts")).cast("timestamp"))) / 600)
    agg = ev.groupBy("event_type", F.to_date("ts").alias("day"), slot.cast("int").alias("slot")) \
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    # a report's fields have a fixed width: flow and depth are parts per thousand of the
    # day's largest slot, so they fit however many events there are
    top = agg.groupBy("event_type", "day").agg(F.max("n").alias("n_top"), F.max("cents").alias("cents_top"))
    part = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)").cast("int")
    agg = agg.join(top, ["event_type", "day"]).select(
        "event_type", "day", "slot", part("n", "n_top").alias("flow"), part("cents", "cents_top").alias("depth"),
        (F.expr("cents div n div 100") / 100.0).alias("vel"))
    days = ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.lit(1).alias("_x"))
    grid = days.select("event_type", "day", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    recs = grid.join(agg, ["event_type", "day", "slot"], "left").select(
        "event_type", "day", "slot",
        F.format_string("%5d%5d%5.2f", F.coalesce("flow", F.lit(0)), F.coalesce("depth", F.lit(0)),
                        F.coalesce("vel", F.lit(0.0))).alias("chunk"))
    line_no = F.floor(F.col("slot") / PER_LINE).cast("int")
    ln = recs.groupBy("event_type", "day", line_no.alias("line")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "chunk"))),
                                 lambda x: x["chunk"]), "").alias("body"))
    ln = ln.withColumn("body", F.when(F.col("line") % 2 == 0, F.concat(F.lit(JUNK), "body"))
                       .otherwise(F.col("body")))
    docs = ln.groupBy("event_type", "day").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))),
                                 lambda x: x["body"]), "\n").alias("data"))
    stamp = F.date_format("day", "yyyyMMdd")
    head = F.concat(F.lit("**IDENTIFIER: 1,"), F.upper("event_type"), F.lit("\n*CSTART\n"),
                    stamp, F.lit("0000 "), stamp, F.lit("2350   10\n*CEND\n"))
    return docs.select(F.concat_ws("-", "event_type", F.date_format("day", "yyyyMMdd")).alias("report_id"),
                       F.concat(F.col("event_type"), F.lit(".fdv")).alias("source_file"),
                       F.concat(head, F.col("data")).alias("text"))


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, _ = parse_flow(render_reports(spark, sf_dir))
    return rec.select("station_id", "time", "record_idx", "flow_l_s", "depth_mm", "velocity_m_s")


ROUNDTRIP_SQL = """
WITH ev AS (SELECT event_type, CAST(ts AS DATE) AS day,
                   CAST(floor(epoch(ts - date_trunc('day', ts)) / 600) AS INTEGER) AS slot, value
            FROM events),
sums AS (SELECT event_type, day, slot, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
         FROM ev GROUP BY 1, 2, 3),
tops AS (SELECT event_type, day, max(n) AS n_top, max(cents) AS cents_top FROM sums GROUP BY 1, 2),
agg AS (SELECT event_type, day, slot, n * 1000 // greatest(n_top, 1) AS flow,
               cents * 1000 // greatest(cents_top, 1) AS depth, (cents // n // 100) / 100.0 AS vel
        FROM sums JOIN tops USING (event_type, day)),
days AS (SELECT DISTINCT event_type, day FROM ev),
g AS (SELECT event_type, day, unnest(range(0, 144)) AS slot FROM days)
SELECT upper(g.event_type) AS station_id,
       CAST(g.day AS TIMESTAMP) + to_minutes(CAST(g.slot * 10 AS BIGINT)) AS time,
       CAST(g.slot + 1 AS INTEGER) AS record_idx,
       CAST(coalesce(a.flow, 0) AS INTEGER) AS flow_l_s,
       CAST(coalesce(a.depth, 0) AS INTEGER) AS depth_mm,
       coalesce(a.vel, 0.0) AS velocity_m_s
FROM g LEFT JOIN agg a USING (event_type, day, slot)
"""


def render_rain_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rain report per gauge (event type) and day: the hourly mean value as the rain
    rate (two decimals, hours without events written as 0), 12 numbers per line, 10-digit
    header range (``yyMMddHHmm``)."""
    ev = table(spark, sf_dir, "events")
    key = ["event_type", "day"]
    agg = ev.groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(
        (F.expr("sum(cast(round(value * 100) as bigint)) div count(value) div 100") / 100.0).alias("rate"))
    grid = agg.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    v = grid.join(agg, [*key, "h"], "left").select(
        *key, "h", F.format_string("%.2f", F.coalesce("rate", F.lit(0.0))).alias("num"))
    ln = v.groupBy(*key, F.floor(F.col("h") / 12).cast("int").alias("line")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "num"))),
                                 lambda x: x["num"]), " ").alias("body"))
    docs = ln.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))),
                                 lambda x: x["body"]), "\n").alias("data"))
    stamp = F.date_format("day", "yyMMdd")
    head = F.concat(F.lit("**IDENTIFIER: 7,RG_"), F.upper("event_type"), F.lit("\n*CSTART\n"), stamp, F.lit("0000 "),
                    stamp, F.lit("2300   60\n*CEND\n"))
    return docs.select(F.concat_ws("-", "event_type", F.date_format("day", "yyyyMMdd")).alias("report_id"),
                       F.concat(F.col("event_type"), F.lit(".r")).alias("source_file"),
                       F.concat(head, "data").alias("text"))


def rain_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, _ = parse_rain(render_rain_reports(spark, sf_dir))
    return rec.select("gauge_id", "time", "record_idx", "rain_mm_hr")


RAIN_ROUNDTRIP_SQL = """
WITH ev AS (SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS h, value FROM events),
agg AS (SELECT event_type, day, h, (CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(value) // 100) / 100.0
               AS rate FROM ev GROUP BY 1, 2, 3),
g AS (SELECT event_type, day, unnest(range(0, 24)) AS h FROM (SELECT DISTINCT event_type, day FROM ev))
SELECT 'RG_' || upper(g.event_type) AS gauge_id, CAST(g.day AS TIMESTAMP) + to_hours(CAST(g.h AS BIGINT)) AS time,
       CAST(g.h + 1 AS INTEGER) AS record_idx, coalesce(a.rate, 0.0) AS rain_mm_hr
FROM g LEFT JOIN agg a USING (event_type, day, h)
"""
