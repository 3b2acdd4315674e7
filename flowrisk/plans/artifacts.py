"""Written and reread tables: report ingestion (E2), reading envelopes (S12, D2, J1) and the
training artifacts (S14, S15, S17, S18), all from the driver's ``events``."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.functions.columns import canonical_id, rnd
from flowrisk.operators import evaluate as ev
from flowrisk.operators import readings as rd
from flowrisk.operators.conformal import nonconformity
from flowrisk.operators.grid import join_exogenous, keep_first_per_time, only_entity
from flowrisk.operators.metrics import exceed, persistence_prob
from flowrisk.plans import evaluation as evq
from flowrisk.plans import report_roundtrip as rpq
from flowrisk.plans import risk_table as rkq
from flowrisk.session import checkpoint_dir
from flowrisk.sources import reports as rp
from flowrisk.sources import readers as rdr
from flowrisk.sources import sinks
from flowrisk.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------ E2
def _zipped(batches):
    for pdf in batches:
        out = []
        for name, content in zip(pdf["source_file"], pdf["content"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"in/{name}", content)
                z.writestr("readme.txt", b"not a report")
            out.append(buffer.getvalue())
        yield pdf.assign(content=out)


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered flow reports as found files: plain on odd days, zipped on even days,
    each in a folder that names two report numbers; one broken archive and one folder with
    a reversed range among them."""
    docs = rpq.render_reports(spark, sf_dir)
    day = F.regexp_extract("report_id", r"(\d{2})$", 1).cast("int")
    f = docs.select(
        F.concat(F.lit("chichester weekly report - interim "), day, F.lit("-"), day + 1).alias("folder"),
        F.concat("report_id", F.lit(".fdv")).alias("source_file"), F.encode("text", "UTF-8").alias("content"),
        (day % 2 == 0).alias("packed"))
    zips = f.where("packed").drop("packed").mapInPandas(
        _zipped, "folder string, source_file string, content binary").withColumn(
        "source_file", F.regexp_replace("source_file", r"\.fdv$", ".zip"))
    bad = spark.range(1).select(F.inline(F.array(
        F.struct(F.lit("chichester weekly report - interim 3").alias("folder"), F.lit("broken.zip").alias("source_file"),
                 F.lit(b"PK not a zip").alias("content")),
        F.struct(F.lit("chichester weekly report - interim 9-3").alias("folder"), F.lit("late.fdv").alias("source_file"),
                 F.lit(b"text").alias("content")))))
    f = f.where("not packed").drop("packed").unionByName(zips).unionByName(bad)
    return f.select("*", F.lower(F.regexp_extract("source_file", r"(\.[^.]+)$", 1)).alias("kind"),
                    rp.folder_report_ids(F.col("folder")).alias("report_ids"))


def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files -> texts (S5, S8) -> records (C1) -> one copy of what several reports hold
    (C3, D3) -> table partitioned by station (S10, S19), and rejects (S9); read back."""
    texts = rp.report_texts(report_files(spark, sf_dir))
    rec, bad = rp.parse_flow(rp.docs_for_parsing(texts))
    rec = rp.replicate_and_dedup(rec, rp.FLOW_COLS)
    root = _folder(spark, "reports")
    rp.write_tables(rec, f"{root}/flow", ["station_id"])
    rp.write_tables(rp.rejected(texts, bad), f"{root}/rejects")
    flow = spark.read.schema(rec.schema).parquet(f"{root}/flow")
    out = flow.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("flow_l_s").alias("flow"), F.sum("depth_mm").alias("depth"),
        F.countDistinct("source_file").alias("files"), F.max("time").cast("timestamp_ntz").alias("last_time"))
    rejects = spark.read.parquet(f"{root}/rejects")
    return out.unionByName(rejects.groupBy(F.lit("rejects").alias("station_id")).agg(F.count(F.lit(1)).alias("n")),
                           allowMissingColumns=True)                       # U1


REPORT_TABLES_SQL = f"""
WITH r AS ({rpq.ROUNDTRIP_SQL})
SELECT station_id, count(*) AS n, CAST(sum(flow_l_s) AS BIGINT) AS flow, CAST(sum(depth_mm) AS BIGINT) AS depth,
       count(DISTINCT CAST(time AS DATE)) AS files, max(time) AS last_time
FROM r GROUP BY 1
UNION ALL SELECT 'rejects', 2, NULL, NULL, NULL, NULL
"""


# ------------------------------------------------------------------------ S12, D2, J1
#: Readings in one envelope, at most.
ENVELOPE_ITEMS = 1000


def envelope_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading envelopes (JSON texts of at most ``ENVELOPE_ITEMS`` readings of a type and minute) parsed
    to rows (S12, F13), the first reading of each hour (D2) joined to the hours of the ``click`` events (J1)."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("dateTime"), "value",
                    F.lit("Good").alias("valueQualifier"))
    minute = F.date_trunc("minute", "ts")
    number = F.row_number().over(Window.partitionBy("event_type", minute).orderBy("ts"))
    texts = e.withColumn("part", F.floor((number - 1) / ENVELOPE_ITEMS)).groupBy("event_type", minute.alias("minute"), "part").agg(
        F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("text")).drop("minute", "part")
    rows = rd.parse_envelope(texts, "text").where(F.col("valueQualifier") == "Good").drop("valueQualifier")
    hour = F.date_trunc("hour", "time")
    first = keep_first_per_time(rows.select("event_type", hour.alias("hour"), F.struct("time", "value").alias("at"), "value"),
                                "event_type", "hour", "at").drop("at")
    hours = first.where(F.col("event_type") == "click").select("hour", F.col("value").alias("click"))
    out = join_exogenous(hours, first.where(F.col("event_type") != "click"), "hour")
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
        F.sum(F.round(F.col("click") * 100).cast("long")).alias("click_cents"))


ENVELOPE_SQL = """
WITH f AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(value, (ts, value)) AS value FROM events GROUP BY 1, 2),
c AS (SELECT hour, value AS click FROM f WHERE event_type = 'click')
SELECT o.event_type, count(*) AS n, CAST(sum(CAST(round(o.value * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(sum(CAST(round(c.click * 100) AS BIGINT)) AS BIGINT) AS click_cents
FROM c LEFT JOIN (SELECT * FROM f WHERE event_type <> 'click') o USING (hour) GROUP BY 1
"""


# ------------------------------------------------------------------------ S1-S4
def landed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed CSV inputs, written from the driver's tables and read by the typed readers
    (S1-S4): flow, rain readings, forecast and monitors; NaN becomes NULL, the qualifier and
    unknown columns are dropped (P4, P5), one entity on request (P15), folders named by
    label (F1)."""
    root = _folder(spark, "landed")
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    amount = F.round("value").cast("int")
    text = lambda c, bad: F.when(bad, F.lit("NaN")).otherwise(F.format_string("%.2f", c))
    flow = e.select(F.col("event_type").alias("station_id"), stamp.alias("time"), F.lit(1).alias("flow_l_s"),
                    amount.alias("depth_mm"), text("value", amount % 7 == 0).alias("velocity_m_s"))
    rain = e.select(rd.station_file_label(F.concat(F.lit("Gauge "), F.initcap("event_type"))).alias("label"),
                    stamp.alias("dateTime"), text("value", amount % 5 == 0).alias("value"), F.lit("Good").alias("valueQualifier"))
    cast = e.groupBy(F.date_trunc("hour", "ts").alias("time")).agg(F.count(F.lit(1)).cast("double").alias("p"))
    cast = cast.select("time", F.col("p").alias("precipitation_surface"), (2 * F.col("p")).alias("precipitation_surface_cum"))
    sup = table(spark, sf_dir, "supplier")
    mon = sup.select(F.lit("flow_monitor").alias("type"), F.concat("s_suppkey", F.lit(".0")).alias("id"),
                     F.lit(None).cast("string").alias("alt_id"), "s_name", F.lit(150.5).alias("pipe_diameter_mm"),
                     F.lit("yes").alias("recently_active"), F.lit(50.8).alias("lat"), F.lit(-0.8).alias("lon"))
    for name, df in (("flow", flow), ("forecast", cast), ("monitors", mon)):
        df.write.option("header", True).csv(f"{root}/{name}")
    rain.write.option("header", True).partitionBy("label").csv(f"{root}/rain")
    one = lambda n, df, v: df.agg(
        F.lit(n).alias("input"), F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"),
        F.sum(F.round(F.col(v) * 100).cast("long")).alias("cents"))
    f = rdr.read_flow(spark, f"{root}/flow")
    r = rdr.read_readings(spark, f"{root}/rain/label=gauge_click", "rain")
    m = rdr.drop_if_present(rdr.read_monitors(spark, f"{root}/monitors"), "lat", "no_such_column")
    ids = rdr.read_monitors(spark, f"{root}/monitors", all_string=True).withColumn("no", canonical_id("id").cast("double"))
    out = one("flow", f, "velocity_m_s").unionByName(one("click", only_entity(f, "station_id", "click"), "velocity_m_s"))
    return (out.unionByName(one("rain", r, "rain"))
            .unionByName(one("forecast", rdr.read_forecast(spark, f"{root}/forecast"), "precipitation_surface_cum"))
            .unionByName(one("monitors", m, "pipe_diameter_mm")).unionByName(one("monitor ids", ids, "no")))


LANDED_SQL = """
WITH e AS (SELECT event_type, date_trunc('hour', ts) AS h, CAST(round(value) AS INTEGER) AS a,
                  CAST(round(value * 100) AS BIGINT) AS c FROM events),
hours AS (SELECT h, count(*) AS p FROM e GROUP BY 1)
SELECT 'flow' AS input, count(*) AS n, count(*) FILTER (a % 7 <> 0) AS n_values,
       CAST(sum(c) FILTER (a % 7 <> 0) AS BIGINT) AS cents FROM e
UNION ALL SELECT 'click', count(*), count(*) FILTER (a % 7 <> 0), CAST(sum(c) FILTER (a % 7 <> 0) AS BIGINT)
FROM e WHERE event_type = 'click'
UNION ALL SELECT 'rain', count(*), count(*) FILTER (a % 5 <> 0), CAST(sum(c) FILTER (a % 5 <> 0) AS BIGINT)
FROM e WHERE event_type = 'click'
UNION ALL SELECT 'forecast', count(*), count(*), CAST(sum(200 * p) AS BIGINT) FROM hours
UNION ALL SELECT 'monitors', count(*), count(*), CAST(count(*) * 15050 AS BIGINT) FROM supplier
UNION ALL SELECT 'monitor ids', count(*), count(*), CAST(sum(s_suppkey) * 100 AS BIGINT) FROM supplier
"""


# ------------------------------------------------------------------------ S14, S15, S17, S18
def artifact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric matrix (S14), run and station metadata (S15), conformal scores (S16), best-model
    table (S17) and predictions by station (S18), written and read back: one row per artifact, station and horizon."""
    root = _folder(spark, "artifacts")
    long = evq.metrics_long(spark, sf_dir)
    best = ev.best_models(long)
    risk = rkq.risk(spark, sf_dir)
    sinks.write_metric_matrix(long, f"{root}/metrics")
    sinks.write_run_metadata(best.withColumn("alpha", F.lit(0.1)), f"{root}/runs")
    sinks.write_best_model_table(best, f"{root}/best", evq.HORIZONS)
    sinks.write_predictions(risk.select("station_id", "horizon_hours", "time", "risk_percent", "model"), f"{root}/risk")
    sinks.write_station_info(best.groupBy("station_id").agg(F.count(F.lit(1)).alias("horizons")), f"{root}/stations")
    keys = ["station_id", "horizon_hours"]
    train = rkq.rows(spark, sf_dir).where(~F.col("is_test")).select(
        *keys, exceed("target", 0.5).alias("class"), persistence_prob("mx24").alias("p"))
    sinks.write_conformal_scores(train.select(*keys, "class", nonconformity("class").alias("score")), f"{root}/scores")
    name = lambda n: F.lit(n).alias("artifact")
    kinds = "section string, metric string, Persistence double, EnsembleClassifier double, " \
            "ConformalEnsemble double, station_id string, horizon_hours int"
    models = ["Persistence", "EnsembleClassifier", "ConformalEnsemble"]
    m = spark.read.schema(kinds).option("header", True).csv(f"{root}/metrics")
    m = m.unpivot([*keys, "metric"], models, "model", "value").groupBy(*keys).agg(
        name("metrics"), F.count("value").alias("n"), rnd(F.sum("value"), 4).alias("total"),
        F.max("model").alias("model"))
    runs = spark.read.schema("best_model string, alpha double, station_id string, horizon_hours int").json(f"{root}/runs")
    runs = runs.select(*keys, name("run"), F.lit(1).cast("long").alias("n"), F.col("alpha").alias("total"),
                       F.col("best_model").alias("model"))
    t = spark.read.option("header", True).csv(f"{root}/best")
    t = t.unpivot(["station_id"], [str(h) for h in evq.HORIZONS], "horizon", "model").where("model is not null").select(
        "station_id", F.col("horizon").cast("int").alias("horizon_hours"), name("best"), F.lit(1).cast("long").alias("n"),
        F.lit(None).cast("double").alias("total"), "model")
    p = sinks.read_predictions(spark, f"{root}/risk").groupBy(*keys).agg(
        name("risk"), F.count(F.lit(1)).alias("n"), rnd(F.sum("risk_percent"), 4).alias("total"),
        F.max("model").alias("model"))
    scores = spark.read.parquet(f"{root}/scores").groupBy(*keys).agg(
        name("scores"), F.count("class").alias("n"), rnd(F.sum("score"), 4).alias("total"))
    info = spark.read.schema("horizons long, station_id string").json(f"{root}/stations").select(
        "station_id", name("station"), F.col("horizons").alias("n"))
    out = m.unionByName(runs).unionByName(t).unionByName(p).unionByName(info, allowMissingColumns=True)   # U1
    out = out.unionByName(scores, allowMissingColumns=True)
    return out.withColumn("horizon_hours", F.col("horizon_hours").cast("int")).orderBy("artifact", *keys)   # T7


_RISK = rkq.RISK_SQL.strip()
_CUT = _RISK.rindex("\nSELECT r.station_id")
ARTIFACT_SQL = _RISK[:_CUT] + """,
tests AS (SELECT r.station_id, r.horizon_hours, r.model, round(r.risk_percent, 6) AS risk_percent FROM rkc r),
mm AS (SELECT * FROM ml)
SELECT station_id, CAST(horizon_hours AS INTEGER) AS horizon_hours, 'metrics' AS artifact, count(value) AS n,
       round(sum(value), 4) AS total, 'Persistence' AS model FROM mm GROUP BY 1, 2
UNION ALL SELECT station_id, CAST(horizon_hours AS INTEGER), 'run', 1, 0.1, best_model FROM best
UNION ALL SELECT station_id, CAST(horizon_hours AS INTEGER), 'best', 1, NULL, best_model FROM best
UNION ALL SELECT station_id, CAST(horizon_hours AS INTEGER), 'risk', count(*), round(sum(risk_percent), 4), max(model)
FROM tests GROUP BY 1, 2
UNION ALL SELECT station_id, CAST(horizon_hours AS INTEGER), 'scores', count(*),
       round(sum(CASE WHEN y = 1 THEN 1.0 - p ELSE p END), 4), NULL FROM tr GROUP BY 1, 2
UNION ALL SELECT station_id, NULL, 'station', count(*), NULL, NULL FROM best GROUP BY 1
"""
