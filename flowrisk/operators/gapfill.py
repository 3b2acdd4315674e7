"""Bounded interior gap filling on a regular grid.

Semantics of ``interpolate(limit=L, limit_area="inside")``: a NULL is filled only when
an observation exists before *and* after it, and only for the first ``L`` rows of each
gap (counted from the previous observation).  Values are interpolated linearly between
the two neighbouring observations (positions on the grid).

Neighbour observations are found inside each (key, bucket) copy with running
``last(..., ignorenulls)`` frames in both directions (one ascending, one descending
sort of the bucket).  Gaps longer than the halo are resolved with per-bucket
summaries (last / first observation of the bucket) carried across buckets by running
``max_by`` / ``min_by`` over the small bucket table, so no group ever holds more than
one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.operators.halo import BUCKET, CORE, HaloSpec

RN = "rn"


def _obs(c: str):
    return F.when(F.col(c).isNotNull(),
                  F.struct(F.col(RN).alias("r"), F.col(c).cast("double").alias("v")))


def fill_gaps(layout: DataFrame, keys, cols: Sequence[str], limit: int,
              halo: HaloSpec) -> DataFrame:
    """Fill interior gaps of ``cols`` in a halo-layout frame (columns rn, _bucket, _core).

    ``halo`` is the layout's spec; its halo widths must not exceed the bucket size.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = keys + [BUCKET]
    base = list(layout.columns)
    B, L, Fw = halo.bucket_rows, halo.lookback, halo.lookahead
    if L > B or Fw > B:
        raise ValueError("gap filling needs halo widths <= bucket size")

    # Per bucket (core rows): last observation overall and last one before the next
    # bucket's copy starts; first observation overall and first one after the
    # previous bucket's copy ends.  Carried over the small bucket table they give, for
    # every copy, the nearest observation outside it on either side.
    b, r = F.col(BUCKET), F.col(RN)
    summ = []
    for c in cols:
        has = F.col(c).isNotNull()
        summ += [F.max_by(_obs(c), F.when(has, r)).alias(f"_la_{c}"),
                 F.max_by(_obs(c), F.when(has & (r < (b + 1) * B - L), r)).alias(f"_lp_{c}"),
                 F.min_by(_obs(c), F.when(has, r)).alias(f"_fa_{c}"),
                 F.min_by(_obs(c), F.when(has & (r >= b * B + Fw), r)).alias(f"_fp_{c}")]
    s = layout.where(F.col(CORE)).groupBy(*part).agg(*summ)
    by = Window.partitionBy(*keys).orderBy(BUCKET)
    before2 = by.rowsBetween(Window.unboundedPreceding, -2)
    after2 = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(
        Window.unboundedPreceding, -2)
    carry = []
    for c in cols:
        carry.append(F.coalesce(F.lag(f"_lp_{c}", 1).over(by),
                                F.last(f"_la_{c}", ignorenulls=True).over(before2)
                                ).alias(f"_cp_{c}"))
        carry.append(F.coalesce(F.lead(f"_fp_{c}", 1).over(by),
                                F.last(f"_fa_{c}", ignorenulls=True).over(after2)
                                ).alias(f"_cn_{c}"))
    s = s.select(*part, *carry)
    df = layout.join(s, part, "left")

    fwd = Window.partitionBy(*part).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*part).orderBy(F.col(RN).desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    df = df.select("*", *[F.last(_obs(c), ignorenulls=True).over(fwd).alias(f"_p_{c}")
                          for c in cols])
    df = df.select("*", *[F.last(_obs(c), ignorenulls=True).over(bwd).alias(f"_n_{c}")
                          for c in cols])
    rd = r.cast("double")
    out = []
    for c in cols:
        p = F.coalesce(F.col(f"_p_{c}"), F.col(f"_cp_{c}"))
        n = F.coalesce(F.col(f"_n_{c}"), F.col(f"_cn_{c}"))
        ok = (F.col(c).isNull() & p.isNotNull() & n.isNotNull()
              & ((r - p["r"]) <= F.lit(limit)))
        lin = p["v"] + (n["v"] - p["v"]) * (rd - p["r"]) / (n["r"] - p["r"]).cast("double")
        out.append(F.when(ok, lin).otherwise(F.col(c).cast("double")).alias(c))
    return df.select(*[c for c in base if c not in cols], *out).select(*base)
