"""Station / gauge id resolution and monitor filters.

The alias map is a small dimension (one row per alias key).  It is built with a
priority union and ``row_number() = 1`` per key ("first source wins"), then joined
to the records; the planner broadcasts it when its measured size is under the
broadcast threshold, otherwise the join shuffles on the normalised id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions.columns import canonical_id

# Fixed values of the id rules:
FLOW_SITE_CODE = r"\b(FM\d+|DM\d+)\b"
GAUGE_SITE_CODE = r"\b(RG\d+)\b"
FLOW_FILE_NUMBER = r"(\d{4,5})"
GAUGE_FILE_NUMBER = r"(\d+)\.(?:r|fdv)$"
GAUGE_NUMERIC_ID = r"^2\d+$"


def norm(c) -> F.Column:
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def alias_map(monitors: DataFrame, site_code: str = FLOW_SITE_CODE,
              order: str = "_order") -> DataFrame:
    """Key -> monitor id from the id itself, the upper-cased alt id and the site
    code of the site name; the first source wins (id, then alt id, then site code,
    each in ``order``)."""
    m = monitors.select(F.trim(F.col("id").cast("string")).alias("id"),
                        norm(F.col("alt_id").cast("string")).alias("alt"),
                        F.regexp_extract(F.upper(F.col("site_name")), site_code, 1).alias("code"),
                        F.col(order).alias("_o"))
    parts = [m.select(F.col("id").alias("key"), "id", F.lit(0).alias("_src"), "_o"),
             m.where(F.col("alt").isNotNull()).select(F.col("alt").alias("key"), "id",
                                                      F.lit(1).alias("_src"), "_o"),
             m.where(F.col("code") != "").select(F.col("code").alias("key"), "id",
                                                 F.lit(2).alias("_src"), "_o")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]) \
                .where(F.col("key").isNotNull() & F.col("id").isNotNull())
    u = u.select(norm("key").alias("key"), F.trim("id").alias("value"), "_src", "_o")
    w = Window.partitionBy("key").orderBy("_src", "_o")
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select("key", "value")


def resolve_flow_ids(records: DataFrame, amap: DataFrame, id_col: str = "station_id",
                     source_col: str = "source_file") -> DataFrame:
    """Mapped normalised id, else the first 4-5 digit run of the source name,
    else the normalised id."""
    r = records.withColumn("_key", norm(id_col))
    j = r.join(amap.withColumnRenamed("key", "_key"), "_key", "left")
    file_no = F.nullif(F.regexp_extract(F.col(source_col), FLOW_FILE_NUMBER, 1), F.lit(""))
    return j.withColumn(id_col, F.coalesce(F.col("value"), file_no, F.col("_key"))) \
            .drop("_key", "value")


def resolve_gauge_ids(records: DataFrame, amap: DataFrame, id_col: str = "gauge_id",
                      source_col: str = "source_file") -> DataFrame:
    """Ids ``^2\\d+$`` use the map, then the file number; other ids use the file
    number (the map is ignored); finally the normalised id."""
    r = records.withColumn("_key", norm(id_col))
    j = r.join(amap.withColumnRenamed("key", "_key"), "_key", "left")
    file_no = F.nullif(F.regexp_extract(F.col(source_col), GAUGE_FILE_NUMBER, 1), F.lit(""))
    numeric = F.coalesce(F.col("_key").rlike(GAUGE_NUMERIC_ID), F.lit(False))
    chosen = F.when(numeric, F.coalesce(F.col("value"), file_no)).otherwise(file_no)
    return j.withColumn(id_col, F.coalesce(chosen, F.col("_key"))).drop("_key", "value")


def active_flow_monitors(monitors: DataFrame) -> DataFrame:
    """``recently_active = 'yes' AND type = 'flow_monitor'``."""
    return monitors.where((F.col("recently_active") == "yes") & (F.col("type") == "flow_monitor"))


def station_aliases(monitors: DataFrame) -> DataFrame:
    """P2 helper: (monitor id, alias) pairs for id and non-null alt id."""
    m = monitors.select(canonical_id("id").alias("monitor_id"), "alt_id")
    return m.select("monitor_id", F.col("monitor_id").alias("alias")).unionByName(
        m.where(F.col("alt_id").isNotNull()).select("monitor_id", canonical_id("alt_id").alias("alias")))


def records_of_monitors(records: DataFrame, monitors: DataFrame, id_col: str = "station_id") -> DataFrame:
    """Records whose station id equals a monitor's id or alt id (NULL alt ignored);
    every monitor at once, tagged with its monitor id."""
    al = station_aliases(monitors)
    return records.join(al, canonical_id(id_col) == F.col("alias")).drop("alias")
