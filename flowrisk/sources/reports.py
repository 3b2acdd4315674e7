"""Flow / rain report files -> record tables (E2: S5-S11, S19, C1-C3, D3).

* S6/S7: files are found with ``binaryFile`` + ``recursiveFileLookup``; the report
  folder, its kind (.fdv / .r) and report ids come from the path with regexes.
* S5: text decoding cascade without UDFs: valid UTF-8 (BOM stripped) -> windows-1252
  -> ISO-8859-1 when an undefined windows-1252 byte (81, 8D, 8F, 90, 9D) occurs.
* S8/S9: a ``mapInPandas`` generator hands out the bytes of ``.zip`` members; their choice,
  names and decoding are Column work.  Unreadable archives and folder names become reject rows.
* C1/C2: parsing is pure Column work (``functions.text``) + ``posexplode``; a file
  without section markers becomes a reject row.
* C3: each folder's records are replicated to every report id of its name, then
  deduplicated without the report id, keeping the smallest source file (D3).
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.functions import text as tx

FLOW_COLS = ["station_id", "start_time", "end_time", "interval_min", "time", "record_idx",
             "flow_l_s", "depth_mm", "velocity_m_s"]
RAIN_COLS = ["gauge_id", "start_time", "end_time", "interval_min", "time", "record_idx",
             "rain_mm_hr"]


# ------------------------------------------------------------------------ decoding
def _windows_1252() -> tuple[str, str]:
    """The C1 characters that windows-1252 uses for others, and those (five bytes are undefined)."""
    defined = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    return "".join(map(chr, defined)), bytes(defined).decode("cp1252")


def decode_text(content) -> F.Column:
    """Bytes -> string with the utf-8-sig / cp1252 / latin-1 cascade.

    ISO-8859-1 makes every byte one character, so windows-1252 is that with the characters of
    its own for the C1 ones; this needs no character set that a session may refuse.
    """
    c = F.col(content) if isinstance(content, str) else content
    bom = F.startswith(F.hex(F.substring(c, 1, 3)), F.lit("EFBBBF"))
    body = F.when(bom, F.substring(c, 4, 2147483647)).otherwise(c)
    latin = F.decode(body, "ISO-8859-1")
    undefined_1252 = latin.rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")
    return (F.when(F.is_valid_utf8(body), F.decode(body, "UTF-8"))
            .when(~undefined_1252, F.translate(latin, *_windows_1252()))
            .otherwise(latin))


# ------------------------------------------------------------------------ discovery
def folder_report_ids(folder: F.Column) -> F.Column:
    """Report ids of a folder name: ``... interim 1,3-5 & 7`` or ``pN`` (NULL if neither)."""
    interim = F.regexp_extract(folder, tx.INTERIM_RE, 1)
    period = F.regexp_extract(folder, tx.PERIOD_RE, 1)
    ids = F.when(interim != "", F.transform(tx.expand_int_spec(interim), lambda i: i.cast("string")))
    return F.when(period != "", F.array(period.cast("int").cast("string"))).otherwise(ids)


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` with its report folder, kind and report ids.

    A report folder is a top-level ``interim`` / ``pN`` folder, or a ``pN`` folder
    directly inside a ``pA-B`` container; files are taken at any depth below it.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "content"))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    parts = F.split(rel, "/")
    top = parts[0]
    second = F.when(F.size(parts) > 2, parts[1])
    in_container = top.rlike(tx.PERIOD_RANGE_RE) & second.rlike(tx.PERIOD_RE)
    folder = F.when(in_container, second).when(top.rlike(tx.INTERIM_RE) | top.rlike(tx.PERIOD_RE), top)
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select("path", "content", folder.alias("folder"), name.alias("source_file"),
                        suffix.alias("kind"), folder_report_ids(folder).alias("report_ids")) \
                .where(F.col("folder").isNotNull())


_MEMBER_SCHEMA = T.StructType([
    T.StructField("folder", T.StringType()), T.StructField("report_ids", T.ArrayType(T.StringType())),
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def _unzip(batches):
    """Files of each archive, as bytes; one row with the error for an unreadable archive."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            place = (r.folder, r.report_ids, r.source_file)
            try:
                archive = zipfile.ZipFile(io.BytesIO(r.content))
                rows = [(*place, i.filename, archive.read(i), None) for i in archive.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:  # broken, encrypted, unknown method
                rows = [(*place, None, None, str(e))]
            yield pd.DataFrame(rows, columns=_MEMBER_SCHEMA.fieldNames())


def report_texts(files: DataFrame) -> DataFrame:
    """S5 + S8: one row per report text (plain files decoded, zip members expanded).

    Files are read once: plain reports and archives part by kind, and archives carry their
    folder along.  A folder whose report numbers cannot be read (a reversed range) and an
    archive that cannot be opened give a row with ``reject_reason`` and no text.
    """
    bad_folder = F.when(F.col("report_ids").isNull(), F.lit("unreadable report numbers in the folder name"))
    plain = files.where(F.col("kind").isin(".fdv", ".r")).select(
        "folder", "report_ids", "source_file", "kind", F.when(bad_folder.isNull(), decode_text("content")).alias("text"),
        bad_folder.alias("reject_reason"))
    members = (files.where(F.col("kind") == ".zip").select("folder", "report_ids", "source_file", "content")
               .mapInPandas(_unzip, _MEMBER_SCHEMA))
    kind = F.lower(F.regexp_extract("member", r"(?i)(\.fdv|\.r)$", 1))
    members = members.where(F.col("error").isNotNull() | (kind != "")).select(
        "folder", "report_ids",
        F.when(F.col("member").isNull(), F.col("archive")).otherwise(F.concat_ws("::", "archive", "member")).alias("source_file"),
        F.when(F.col("member").isNull(), F.lit(".zip")).otherwise(kind).alias("kind"),
        F.when(bad_folder.isNull(), decode_text("content")).alias("text"),
        F.coalesce(F.concat(F.lit("bad zip: "), "error"), bad_folder).alias("reject_reason"))
    return plain.unionByName(members)


def rejected(texts: DataFrame, *parse_rejects: DataFrame) -> DataFrame:
    """One reject table: unreadable archives and folders, and texts that did not parse."""
    out = texts.where(F.col("reject_reason").isNotNull()).select(
        F.lit(None).cast("string").alias("report_id"), "source_file", F.col("reject_reason").alias("reason"))
    for r in parse_rejects:
        out = out.unionByName(r.select("report_id", "source_file", "reason"))
    return out


# ------------------------------------------------------------------------ parsing
def parse_flow(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects).  ``docs`` has report_id, source_file, text."""
    t = F.col("text")
    start, end, iv = tx.header_range(t)
    d = docs.select("*", tx.identifier(t).alias("station_id"), start.alias("start_time"),
                    end.alias("end_time"), iv.alias("interval_min"),
                    tx.flow_chunks(t).alias("_chunks"))
    rejects = d.where(F.col("_chunks").isNull()).select(
        "report_id", "source_file", F.lit("missing *CSTART/*CEND markers").alias("reason"))
    extra = [c for c in docs.columns if c not in ("report_id", "source_file", "text")]
    rec = d.where(F.col("_chunks").isNotNull()).select(
        "report_id", "station_id", "source_file", "start_time", "end_time", "interval_min",
        *extra, F.posexplode("_chunks").alias("_pos", "_chunk"))
    idx = (F.col("_pos") + 1).cast("int")
    rec = rec.select(
        "report_id", "station_id", "source_file", "start_time", "end_time", "interval_min", *extra,
        tx.timestamp_at(F.col("start_time"), F.col("interval_min"), idx).alias("time"),
        idx.alias("record_idx"),
        F.regexp_extract("_chunk", tx.CHUNK_RE, 1).try_cast("int").alias("flow_l_s"),
        F.regexp_extract("_chunk", tx.CHUNK_RE, 2).try_cast("int").alias("depth_mm"),
        F.regexp_extract("_chunk", tx.CHUNK_RE, 3).cast("double").alias("velocity_m_s"))
    return rec, rejects


def parse_rain(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of rain-gauge reports."""
    t = F.col("text")
    start, end, iv = tx.header_range(t)
    d = docs.select("*", tx.identifier(t).alias("gauge_id"), start.alias("start_time"),
                    end.alias("end_time"), iv.alias("interval_min"),
                    tx.rain_values(t).alias("_vals"))
    rejects = d.where(F.col("_vals").isNull()).select(
        "report_id", "source_file", F.lit("missing *CSTART/*CEND markers").alias("reason"))
    extra = [c for c in docs.columns if c not in ("report_id", "source_file", "text")]
    rec = d.where(F.col("_vals").isNotNull()).select(
        "report_id", "gauge_id", "source_file", "start_time", "end_time", "interval_min",
        *extra, F.posexplode("_vals").alias("_pos", "_v"))
    idx = (F.col("_pos") + 1).cast("int")
    rec = rec.select("report_id", "gauge_id", "source_file", "start_time", "end_time",
                     "interval_min", *extra,
                     tx.timestamp_at(F.col("start_time"), F.col("interval_min"), idx).alias("time"),
                     idx.alias("record_idx"), F.col("_v").cast("double").alias("rain_mm_hr"))
    return rec, rejects


def replicate_and_dedup(records: DataFrame, subset: list[str]) -> DataFrame:
    """C3 + D3: copy each folder's records to every report id of its name (column
    ``report_ids``), then drop duplicates on ``subset`` (report id excluded), keeping
    the smallest source file name (deterministic)."""
    r = records.select("*", F.explode("report_ids").alias("_rid"))
    return r.groupBy(*subset).agg(F.min("source_file").alias("source_file"))


def docs_for_parsing(texts: DataFrame) -> DataFrame:
    """Readable report texts -> parser input: the folder's first report id labels its records."""
    return texts.where(F.col("text").isNotNull()).withColumn("report_id", F.col("report_ids")[0])


def write_tables(df: DataFrame, path: str, partition_cols=(), fmt: str = "parquet") -> None:
    """Overwrite the output; with partition columns only the partitions
    present in ``df`` are replaced (dynamic partition overwrite)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.format(fmt).option("header", True).save(path)
