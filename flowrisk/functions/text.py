"""Column expressions for report text (F1-F9), no UDFs.

Fixed values of the report grammar (must match the reports being read):
    identifier line      ^\\*\\*IDENTIFIER:\\s*\\d+,(.+)$        (multi-line)
    12-digit range       (\\d{12})\\s+(\\d{12})\\s+(\\d+)          yyyyMMddHHmm
    10-digit range       (\\d{10})\\s+(\\d{10})\\s+(\\d+)          yyMMddHHmm
    section markers      lines starting with *CSTART and *CEND
    flow record chunk    15 characters: ^\\s*(-?\\d+)\\s+(-?\\d+)\\s+(-?\\d+(?:\\.\\d+)?)\\s*$
    rain values          -?\\d+(?:\\.\\d+)?
    interim folder       ^chichester\\s+weekly\\s+report\\s*-\\s*interim\\s+([\\d,\\s&-]+)$  (any case)
    period folder        ^p(\\d+)$ ; range container ^p(\\d+)-(\\d+)$       (any case)
    number or range      \\d+\\s*-\\s*\\d+|\\d+
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER_RE = r"(?m)^\*\*IDENTIFIER:\s*\d+,(.+)$"
RANGE12_RE = r"(\d{12})\s+(\d{12})\s+(\d+)"
RANGE10_RE = r"(\d{10})\s+(\d{10})\s+(\d+)"
CHUNK_RE = r"^\s*(-?\d+)\s+(-?\d+)\s+(-?\d+(?:\.\d+)?)\s*$"
NUMBER_RE = r"-?\d+(?:\.\d+)?"
INTERIM_RE = r"(?i)^chichester\s+weekly\s+report\s*-\s*interim\s+([\d,\s&-]+)$"
PERIOD_RE = r"(?i)^p(\d+)$"
PERIOD_RANGE_RE = r"(?i)^p(\d+)-(\d+)$"
INT_SPEC_RE = r"\d+\s*-\s*\d+|\d+"
CHUNK = 15


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def marker_pos(ls: Column, marker: str) -> Column:
    """1-based index of the first line starting with ``marker``; 0 when absent."""
    return F.array_position(F.transform(ls, lambda l: l.startswith(marker)), True)


def data_lines(text: Column) -> Column:
    """lines after the *CEND marker (needs *CSTART too; else NULL -> reject)."""
    ls = lines(text)
    cs, ce = marker_pos(ls, "*CSTART"), marker_pos(ls, "*CEND")
    return F.when((cs > 0) & (ce > 0), F.slice(ls, ce + 1, F.greatest(F.size(ls) - ce, F.lit(0))))


def identifier(text: Column) -> Column:
    v = F.trim(F.regexp_extract(text, IDENTIFIER_RE, 1))
    return F.when(v != "", v)


def parse_stamp(s: Column, digits: int) -> Column:
    """F8: ``yyyyMMddHHmm`` or ``yyMMddHHmm`` (two-digit years 69-99 mean 19xx)."""
    if digits == 12:
        return F.try_to_timestamp(s, F.lit("yyyyMMddHHmm"))
    t = F.try_to_timestamp(s, F.lit("yyMMddHHmm"))
    yy = F.substring(s, 1, 2).cast("int")
    return F.when(yy >= 69, F.add_months(t, -1200).cast("timestamp")
                  + (t - F.date_trunc("day", t))).otherwise(t)


def header_range(text: Column) -> tuple[Column, Column, Column]:
    """(start, end, interval minutes): the 12-digit form first, else the 10-digit one."""
    has12 = F.regexp_extract(text, RANGE12_RE, 0) != ""
    has10 = F.regexp_extract(text, RANGE10_RE, 0) != ""
    s12, e12 = (F.regexp_extract(text, RANGE12_RE, i) for i in (1, 2))
    s10, e10 = (F.regexp_extract(text, RANGE10_RE, i) for i in (1, 2))
    start = F.when(has12, parse_stamp(s12, 12)).when(has10, parse_stamp(s10, 10))
    end = F.when(has12, parse_stamp(e12, 12)).when(has10, parse_stamp(e10, 10))
    iv = F.when(has12, F.regexp_extract(text, RANGE12_RE, 3).try_cast("int")) \
          .when(has10, F.regexp_extract(text, RANGE10_RE, 3).try_cast("int"))
    return start, end, iv


def chunks(line: Column) -> Column:
    """fixed-width 15-character pieces of a line."""
    idx = F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)), F.lit(CHUNK))
    return F.transform(idx, lambda i: F.substring(line, i, CHUNK))


def flow_chunks(text: Column) -> Column:
    """All valid ``flow depth velocity`` chunks of the data section, in order.
    Blank and non-matching chunks are dropped, so they take no record slot."""
    per_line = F.transform(data_lines(text), lambda l: F.filter(
        chunks(l), lambda c: (F.trim(c) != "") & c.rlike(CHUNK_RE)))
    return F.flatten(per_line)


def rain_values(text: Column) -> Column:
    """every number of every data line, in order."""
    return F.flatten(F.transform(data_lines(text),
                                 lambda l: F.regexp_extract_all(l, F.lit(NUMBER_RE), 0)))


def timestamp_at(start: Column, interval_min: Column, record_idx: Column) -> Column:
    """``start + (idx - 1) * interval`` minutes; NULL when the header is absent."""
    return start + F.make_dt_interval(F.lit(0), F.lit(0), (record_idx - 1) * interval_min,
                                      F.lit(0))


def expand_int_spec(spec: Column) -> Column:
    """``1,3-5 & 7`` -> [1, 3, 4, 5, 7] in first-seen order without repeats.
    A reversed range yields NULL (the caller rejects the row)."""
    parts = F.regexp_extract_all(spec, F.lit(INT_SPEC_RE), 0)

    def one(p):
        q = F.regexp_replace(p, r"\s", "")
        a = F.split(q, "-")
        lo = a[0].try_cast("int")
        hi = F.when(F.size(a) > 1, a[1].try_cast("int")).otherwise(lo)
        return F.when(hi >= lo, F.sequence(lo, hi))

    arrs = F.transform(parts, one)
    bad = F.exists(arrs, lambda x: x.isNull())
    return F.when(~bad, F.array_distinct(F.flatten(arrs)))
