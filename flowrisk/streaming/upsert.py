"""Continuous readings merge (I2): the incremental upsert as a Structured Streaming job.

file source -> ``withWatermark`` -> ``dropDuplicatesWithinWatermark`` (repeated deliveries
of one reading; state bounded by the watermark, and readings older than it are dropped) ->
``foreachBatch``: each micro-batch is merged into the target table by (key, time), the
latest arrival winning.  A reading that is late but within the watermark is merged like any
other.  The target is partitioned by key and day, and a batch reads and rewrites only the
(key, day) partitions that it touches (a pruned join, dynamic partition overwrite), whatever the
length of the history; the merged partitions are first staged in the checkpoint folder so a partition
is never read and overwritten by the same job.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.session import checkpoint_dir, stage


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")) or fs.exists(p) and \
        len(fs.listStatus(p)) > 0


DAY, ARRIVAL = "day", "arrival"


def partitions_listed(old: DataFrame, listed: DataFrame, parts: list[str]) -> DataFrame:
    """The rows of ``old``, partitioned by ``parts`` (the last one a date), in the partitions that
    ``listed`` names; null is a partition value like any other.

    A join, so the plan is the same for any number of partitions.  The first and last date prune
    the scan from the start, the join's values prune it at run time where ``listed`` is small
    enough for the planner to broadcast; a longer list is joined by a shuffle.
    """
    day = parts[-1]
    first, last = listed.agg(F.min(day), F.max(day)).first()
    known = F.lit(True)
    for c in parts:
        known &= F.col(c).isNotNull()
    span = F.col(day).between(first, last)
    whole = old.where(known & span).join(listed.where(known & span), parts, "left_semi")
    other = listed.where(~known)
    same = F.lit(True)
    for c in parts:
        same &= old[c].eqNullSafe(other[c])
    return whole.unionByName(old.where(~known).join(other, same, "left_semi"))


def merge_batch(batch: DataFrame, batch_id: int, target: str, keys: list[str], time: str) -> None:
    """Merge one micro-batch by (keys, time); equal times within it go to the largest values."""
    spark = batch.sparkSession
    cols = [*batch.columns, ARRIVAL]
    new = batch.withColumn(ARRIVAL, F.lit(int(batch_id))).withColumn(DAY, F.to_date(time))
    if _exists(spark, target):
        kinds = T.StructType([f for f in new.schema.fields if f.name not in (*keys, DAY)]
                             + [new.schema[c] for c in (*keys, DAY)])
        old = spark.read.schema(kinds).parquet(target)
        listed = stage(new.select(*keys, DAY).distinct(), "touched")
        new = partitions_listed(old, listed, [*keys, DAY]).unionByName(new)
    others = [c for c in cols if c not in keys and c not in (time, ARRIVAL)]
    best = F.max(F.struct(ARRIVAL, *others)).alias("_r")
    merged = new.groupBy(*keys, DAY, time).agg(best).select(
        time, *[F.col(f"_r.{c}").alias(c) for c in (ARRIVAL, *others)], *keys, DAY)
    merged = stage(merged, "merge")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys, DAY).parquet(target))


def run_upsert_stream(spark: SparkSession, source: str, schema: T.StructType, keys: list[str],
                      time: str, target: str, checkpoint: str, watermark: str = "1 day",
                      max_files_per_trigger: int = 1, base_path: str | None = None) -> None:
    """Run the stream until every available file is processed (``availableNow``).
    ``source`` is a directory or a glob; ``base_path`` is its folder for a glob."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if base_path:
        r = r.option("basePath", base_path)
    s = r.parquet(source)
    s = s.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark) \
         .dropDuplicatesWithinWatermark(s.columns)
    q = (s.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, target, keys, time))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _summary(t: DataFrame) -> DataFrame:
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                       F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 on the driver's ``events``: stream the table, merge into a keyed table, return
    per-type counts of the stored readings."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = os.path.join(sf_dir, "events.parquet")
    glob = os.path.join(sf_dir, "events.parq[u]et")   # a glob: the source lists files, not a folder
    schema = spark.read.parquet(src).select("event_type", "ts", "value").schema
    run_upsert_stream(spark, glob, schema, ["event_type"], "ts", f"{root}/table", f"{root}/ckpt")
    return _summary(spark.read.parquet(f"{root}/table"))


#: Files that a micro-batch of the replay takes.
FILES_AT_ONCE = 8


def replay_out_of_order(spark: SparkSession, sf_dir: str, days_per_file: int = 12) -> DataFrame:
    """I2 on late data: the events arrive in files of some days each, the newest days first,
    then all readings once more with a corrected value (value + 1).  The watermark spans
    the files, so every reading is merged and the correction wins, also within one batch."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("event_type", "ts", "value")
    part = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / days_per_file)
    span = ev.agg(F.min(part), F.max(part)).first()
    for add in (0.0, 1.0):
        for p in range(span[1], span[0] - 1, -1):     # a file is listed by its time of writing
            (ev.where(part == p).withColumn("value", F.col("value") + add)
             .write.mode("append").parquet(f"{root}/in"))
    days = (span[1] - span[0] + 2) * days_per_file
    run_upsert_stream(spark, f"{root}/in", ev.schema, ["event_type"], "ts", f"{root}/table", f"{root}/ckpt",
                      watermark=f"{days} days", max_files_per_trigger=FILES_AT_ONCE)
    t = spark.read.parquet(f"{root}/table")
    return t.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
        F.countDistinct("day").alias("days"))


REPLAY_SQL = """
WITH r AS (SELECT event_type, ts, max(value + 1.0) AS v FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS n, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents,
       count(DISTINCT CAST(ts AS DATE)) AS days
FROM r GROUP BY 1
"""

STREAM_SQL = """
SELECT event_type, count(DISTINCT ts) AS n, max(ts) AS last_ts FROM events GROUP BY 1
"""
