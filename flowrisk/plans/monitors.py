"""Monitor dimension and id resolution on driver tables.

* monitors <- ``supplier``: id = suppkey, flow monitors get ``FM``/``DM`` site codes,
  rain gauges (negative balance) get ``RG`` codes and ids 2000 + suppkey; larger
  balances carry an alt id ``<30000 + suppkey>.0``; "recently active" = shipped in
  the last 365 days of ``lineitem``.
* flow records <- ``lineitem`` with raw station ids in several spellings by line number;
  gauge records <- ``orders`` with raw gauge ids by priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.columns import attach_scalars

from flowrisk.operators import ids
from flowrisk.sources.tables import table


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate")
    last = li.agg(F.max("l_shipdate").alias("_mx"))
    recent = attach_scalars(li, last).where(
        F.col("l_shipdate") > F.date_sub(F.col("_mx"), 365)).select("l_suppkey").distinct()
    gauge = F.col("s_acctbal") < 0
    mid = F.when(gauge, F.col("s_suppkey") + 2000).otherwise(F.col("s_suppkey")).cast("string")
    code = F.when(gauge, F.lit("RG")).when(F.col("s_nationkey") < 12, F.lit("FM")).otherwise(F.lit("DM"))
    code_no = F.when(gauge, F.col("s_suppkey")).otherwise(F.col("s_nationkey")).cast("string")
    m = s.select(
        F.when(gauge, F.lit("rain_gauge")).otherwise(F.lit("flow_monitor")).alias("type"),
        mid.alias("id"),
        F.when(F.col("s_acctbal") > 5000,
               F.concat((F.col("s_suppkey") + 30000).cast("string"), F.lit(".0"))).alias("alt_id"),
        F.concat(code, code_no, F.lit(" - "), F.col("s_name")).alias("site_name"),
        ((F.col("s_nationkey") + 1) * 25.0).alias("pipe_diameter_mm"),
        F.col("s_suppkey").alias("_order"))
    act = recent.select(F.col("l_suppkey").alias("_order"), F.lit("yes").alias("_act"))
    return m.join(act, "_order", "left").withColumn(
        "recently_active", F.coalesce("_act", F.lit("no"))).drop("_act")


def flow_records(spark: SparkSession, sf_dir: str, mon: DataFrame) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    sup = mon.select(F.col("_order").alias("l_suppkey"), "alt_id", "site_name")
    r = li.join(sup, "l_suppkey", "left")
    code = F.regexp_extract(F.col("site_name"), r"^(\S+)", 1)
    raw = (F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey").cast("string"))
           .when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), F.lower(code), F.lit(" ")))
           .when(F.col("l_linenumber") == 4, F.coalesce(F.lower("alt_id"), F.col("l_suppkey").cast("string")))
           .when(F.col("l_linenumber") == 5, F.concat(F.lit("X"), F.col("l_suppkey").cast("string")))
           .otherwise(F.concat(F.lit(" m"), F.col("l_suppkey").cast("string"))))
    return r.select("l_orderkey", "l_linenumber", raw.alias("station_id"),
                    F.concat(F.lit("site_"), F.col("l_orderkey").cast("string"), F.lit(".fdv"))
                    .alias("source_file"))


def flow_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mon = monitors(spark, sf_dir)
    rec = flow_records(spark, sf_dir, mon).withColumn("raw_id", F.col("station_id"))
    out = ids.resolve_flow_ids(rec, ids.alias_map(mon))
    return out.select("l_orderkey", "l_linenumber", "raw_id", "station_id")


def gauge_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mon = monitors(spark, sf_dir)
    g = mon.where(F.lower(F.col("type")) == "rain_gauge")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = F.substring("o_orderpriority", 1, 1)
    raw = (F.when(p == "1", (F.col("o_custkey") + 2000).cast("string"))
           .when(p == "2", F.concat(F.lit("rg"), F.col("o_custkey").cast("string")))
           .when(p == "3", F.concat(F.lit(" "), (F.col("o_custkey") + 2000).cast("string"), F.lit(" ")))
           .when(p == "4", F.lit("ABC"))
           .otherwise(F.concat(F.lit("2"), F.col("o_orderkey").cast("string"))))
    rec = o.select("o_orderkey", raw.alias("gauge_id"),
                   F.concat(F.lit("gauge"), F.col("o_orderkey").cast("string"), F.lit(".r"))
                   .alias("source_file")).withColumn("raw_id", F.col("gauge_id"))
    out = ids.resolve_gauge_ids(rec, ids.alias_map(g, ids.GAUGE_SITE_CODE))
    return out.select("o_orderkey", "raw_id", "gauge_id")


def active_monitor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2 + P3: per active flow monitor, its non-negative-quantity records
    matched by id or alt id."""
    mon = ids.active_flow_monitors(monitors(spark, sf_dir))
    li = table(spark, sf_dir, "lineitem")
    rec = li.select(F.when(F.col("l_linenumber") == 4,
                           F.concat((F.col("l_suppkey") + 30000).cast("string"), F.lit(".0")))
                    .otherwise(F.col("l_suppkey").cast("string")).alias("station_id"),
                    "l_quantity").where(F.col("l_quantity") >= 0)
    m = ids.records_of_monitors(rec, mon)
    return m.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n_records"),
                                       F.sum("l_quantity").alias("quantity"))


_MON_SQL = """
WITH last AS (SELECT max(l_shipdate) AS mx FROM lineitem),
recent AS (SELECT DISTINCT l_suppkey FROM lineitem, last
           WHERE l_shipdate > CAST(mx AS DATE) - INTERVAL 365 DAY),
mon AS (
  SELECT CASE WHEN s_acctbal < 0 THEN 'rain_gauge' ELSE 'flow_monitor' END AS type,
         CAST(CASE WHEN s_acctbal < 0 THEN s_suppkey + 2000 ELSE s_suppkey END AS VARCHAR) AS id,
         CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey + 30000 AS VARCHAR) || '.0' END AS alt_id,
         CASE WHEN s_acctbal < 0 THEN 'RG' WHEN s_nationkey < 12 THEN 'FM' ELSE 'DM' END ||
         CAST(CASE WHEN s_acctbal < 0 THEN s_suppkey ELSE s_nationkey END AS VARCHAR) || ' - ' || s_name
           AS site_name,
         s_suppkey AS ord,
         CASE WHEN s_suppkey IN (SELECT l_suppkey FROM recent) THEN 'yes' ELSE 'no' END AS recently_active
  FROM supplier)
"""


def _amap_sql(src: str, code_re: str) -> str:
    return f"""
amap0 AS (
  SELECT upper(trim(trim(id))) AS key, trim(id) AS value, 0 AS src, ord FROM {src} WHERE id IS NOT NULL
  UNION ALL
  SELECT upper(trim(upper(trim(alt_id)))), trim(id), 1, ord FROM {src} WHERE alt_id IS NOT NULL
  UNION ALL
  SELECT upper(trim(regexp_extract(upper(site_name), '{code_re}', 1))), trim(id), 2, ord FROM {src}
  WHERE regexp_extract(upper(site_name), '{code_re}', 1) <> ''),
amap AS (SELECT key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, ord) AS rn FROM amap0) WHERE rn = 1)
"""


FLOW_ID_SQL = _MON_SQL + ", " + _amap_sql("mon", ids.FLOW_SITE_CODE) + """,
rec AS (
  SELECT l.l_orderkey, l.l_linenumber,
         CASE WHEN l.l_linenumber <= 2 THEN CAST(l.l_suppkey AS VARCHAR)
              WHEN l.l_linenumber = 3 THEN ' ' || lower(regexp_extract(m.site_name, '^(\\S+)', 1)) || ' '
              WHEN l.l_linenumber = 4 THEN coalesce(lower(m.alt_id), CAST(l.l_suppkey AS VARCHAR))
              WHEN l.l_linenumber = 5 THEN 'X' || CAST(l.l_suppkey AS VARCHAR)
              ELSE ' m' || CAST(l.l_suppkey AS VARCHAR) END AS raw_id,
         'site_' || CAST(l.l_orderkey AS VARCHAR) || '.fdv' AS source_file
  FROM lineitem l LEFT JOIN mon m ON m.ord = l.l_suppkey)
SELECT r.l_orderkey, r.l_linenumber, r.raw_id,
       coalesce(a.value, nullif(regexp_extract(r.source_file, '(\\d{4,5})', 1), ''),
                upper(trim(r.raw_id))) AS station_id
FROM rec r LEFT JOIN amap a ON a.key = upper(trim(r.raw_id))
"""

GAUGE_ID_SQL = _MON_SQL + ", g AS (SELECT * FROM mon WHERE lower(type) = 'rain_gauge'), " + \
    _amap_sql("g", ids.GAUGE_SITE_CODE) + """,
rec AS (
  SELECT o_orderkey,
         CASE substr(o_orderpriority, 1, 1)
              WHEN '1' THEN CAST(o_custkey + 2000 AS VARCHAR)
              WHEN '2' THEN 'rg' || CAST(o_custkey AS VARCHAR)
              WHEN '3' THEN ' ' || CAST(o_custkey + 2000 AS VARCHAR) || ' '
              WHEN '4' THEN 'ABC'
              ELSE '2' || CAST(o_orderkey AS VARCHAR) END AS raw_id,
         'gauge' || CAST(o_orderkey AS VARCHAR) || '.r' AS source_file
  FROM orders),
j AS (SELECT r.*, a.value, upper(trim(r.raw_id)) AS k,
             nullif(regexp_extract(r.source_file, '(\\d+)\\.(?:r|fdv)$', 1), '') AS file_no
      FROM rec r LEFT JOIN amap a ON a.key = upper(trim(r.raw_id)))
SELECT o_orderkey, raw_id,
       coalesce(CASE WHEN regexp_matches(k, '^2\\d+$') THEN coalesce(value, file_no) ELSE file_no END,
                k) AS gauge_id
FROM j
"""

ACTIVE_SQL = _MON_SQL + """,
act AS (SELECT * FROM mon WHERE recently_active = 'yes' AND type = 'flow_monitor'),
al AS (SELECT regexp_replace(trim(id), '\\.0+$', '') AS monitor_id, regexp_replace(trim(id), '\\.0+$', '') AS alias FROM act
       UNION ALL
       SELECT regexp_replace(trim(id), '\\.0+$', ''), regexp_replace(trim(alt_id), '\\.0+$', '') FROM act
       WHERE alt_id IS NOT NULL),
rec AS (SELECT CASE WHEN l_linenumber = 4 THEN CAST(l_suppkey + 30000 AS VARCHAR) || '.0'
                    ELSE CAST(l_suppkey AS VARCHAR) END AS station_id, l_quantity
        FROM lineitem WHERE l_quantity >= 0)
SELECT al.monitor_id, count(*) AS n_records, sum(l_quantity) AS quantity
FROM rec JOIN al ON regexp_replace(trim(rec.station_id), '\\.0+$', '') = al.alias
GROUP BY al.monitor_id
"""
