"""Trailing / forward / lag window features over regular grids.

Every window follows pandas ``rolling(n, min_periods=n)``: the result is NULL unless
all ``n`` rows of the window exist and are non-null.

Formulations (all over ``Window.partitionBy(keys, _bucket).orderBy(rn)``):

* sum / mean / var / std / counts: running (prefix) sums minus ``lag(prefix, n)`` —
  O(1) per row whatever ``n`` is.  Values are centred on the bucket mean first to
  limit cancellation.
* max / min: a shared doubling table ``M_k = greatest(M_{k/2}, lag(M_{k/2}, k/2))``
  (sparse table); a window of n rows is ``greatest(M_p, lag(M_p, n - p))`` with
  ``p`` the largest power of two <= n.  O(log n) columns shared by all window sizes.
* forward windows: the trailing result read ``n-1`` (or ``n``) rows ahead with ``lead``.
* median / quantile / percentile-of-current: pandas rolling kernels (skip-list,
  O(log n) per row) inside ``applyInPandas`` over the (key, bucket) groups.
* hours-since-last-true and cumulative sums need unbounded history: per-bucket
  summaries are prefix-combined over the small bucket table and joined back.

Spark's own sliding frames re-aggregate every frame (O(n*w)); ``sliding_reference``
keeps that form for property tests.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.functions.columns import col, falsey, flag, safe_div
from flowrisk.operators.halo import BUCKET, CORE

RN = "rn"

TRAIL = {"trail_max", "trail_min", "trail_sum", "trail_mean", "trail_std", "trail_var",
         "range"}
FWD = {"fwd_sum", "fwd_max", "fwd_min", "fwd_var", "fwd_mean"}
PANDAS = {"median_ratio", "pct_current", "quantile", "gt_quantile", "median"}
CARRY = {"hours_since", "hours_since_nonzero", "cumsum"}


def rows(hours: float, freq_minutes: float) -> int:
    """Rows covered by ``hours`` on a grid of ``freq_minutes`` (Python rounding)."""
    return int(round(hours * 60 / freq_minutes))


@dataclass(frozen=True)
class Feat:
    """One derived column.  ``op`` selects the operator; ``n`` is a row count."""
    name: str
    op: str
    col: str | None = None
    n: int = 0
    hours: float = 1.0
    thr: float | None = None
    q: float | None = None
    col2: str | None = None
    expr: object = field(default=None, compare=False, hash=False)  # Column or () -> Column

    @property
    def lookback(self) -> int:
        if self.op in TRAIL or self.op in PANDAS or self.op in ("hours_above", "count_above"):
            return max(self.n - 1, 0)
        if self.op in ("lag", "slope", "cum_diff"):
            return self.n
        if self.op == "diff_rate":
            return 1
        if self.op == "accel":
            return self.n + 1
        return 0

    @property
    def lookahead(self) -> int:
        if self.op in FWD:
            return max(self.n - 1, 0)
        if self.op == "next_max":
            return self.n
        return 0


def halo_of(feats: Sequence[Feat]) -> tuple[int, int]:
    return (max([f.lookback for f in feats] + [0]), max([f.lookahead for f in feats] + [0]))


def _pow2_floor(n: int) -> int:
    p = 1
    while p * 2 <= n:
        p *= 2
    return p


# --------------------------------------------------------------------------- pandas
def _pandas_stage(df: DataFrame, part: list[str], feats: list[Feat]) -> DataFrame:
    """Rolling median / quantile / rank-of-current per (key, bucket) group (Arrow)."""
    jobs = []
    for f in feats:
        if f.op in ("median_ratio", "median"):
            jobs.append((f"_med_{f.col}_{f.n}", "median", f.col, f.n, None))
        elif f.op in ("quantile", "gt_quantile"):
            jobs.append((pandas_names(f), "quantile", f.col, f.n, f.q))
        elif f.op == "pct_current":
            jobs.append((f"_pct_{f.col}_{f.n}", "pct", f.col, f.n, None))
    jobs = list(dict.fromkeys(jobs))
    schema = T.StructType(df.schema.fields + [T.StructField(j[0], T.DoubleType()) for j in jobs])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RN, kind="stable").reset_index(drop=True)
        for name, how, c, n, q in jobs:
            r = pdf[c].astype("float64").rolling(n, min_periods=n)
            if how == "median":
                pdf[name] = r.median()
            elif how == "quantile":
                pdf[name] = r.quantile(q, interpolation="linear")
            else:  # share of window values <= the current one
                pdf[name] = r.rank(method="max", pct=True)
        return pdf

    return df.groupBy(*part).applyInPandas(kernel, schema)


def pandas_names(f: Feat) -> str:
    if f.op in ("median_ratio", "median"):
        return f"_med_{f.col}_{f.n}"
    if f.op in ("quantile", "gt_quantile"):
        return f"_q_{f.col}_{f.n}_" + str(f.q).replace(".", "p")
    return f"_pct_{f.col}_{f.n}"


# --------------------------------------------------------------------------- main
def compute_features(layout: DataFrame, keys, feats: Sequence[Feat], step_hours: float,
                     keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``feats`` to a halo-layout frame; return core rows only.

    ``layout`` comes from ``grid.regular_grid`` (columns keys, rn, _bucket, _core, ...)
    with a halo at least ``halo_of(feats)``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = keys + [BUCKET]
    w = Window.partitionBy(*part).orderBy(RN)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    feats = list(feats)
    base_cols = list(layout.columns)
    helpers: list[str] = []

    df = layout
    if any(f.op in PANDAS for f in feats):
        df = _pandas_stage(df, part, [f for f in feats if f.op in PANDAS])
        helpers += [c for c in df.columns if c not in base_cols]

    # ---- which helper sequences are needed
    sum_cols, cnt_cols, max_lv, min_lv, mask_specs = set(), set(), {}, {}, {}
    need_rows = False
    for f in feats:
        if f.op in TRAIL or f.op in FWD or f.op == "next_max":
            cnt_cols.add(f.col)
            base = f.op.split("_", 1)[1] if f.op != "range" else "range"
            if base in ("sum", "mean", "std", "var"):
                sum_cols.add(f.col)
            if base in ("max", "range"):
                max_lv[f.col] = max(max_lv.get(f.col, 1), _pow2_floor(f.n))
            if base in ("min", "range"):
                min_lv[f.col] = max(min_lv.get(f.col, 1), _pow2_floor(f.n))
        if f.op in ("hours_above", "count_above"):
            mask_specs[(f.col, f.thr)] = f"_m_{f.col}_{f.thr}".replace(".", "p")
            need_rows = True

    # centring reference per (key, bucket)
    ref = {c: f"_ref_{c}" for c in sum_cols}
    if ref:
        # rounded mean: centred integer data stays integer, so its prefix sums are exact
        df = df.select("*", *[F.coalesce(F.round(F.avg(F.col(c).cast("double")).over(whole)),
                                         F.lit(0.0)).alias(ref[c]) for c in sum_cols])
    if mask_specs:
        df = df.select("*", *[flag(F.col(c) > F.lit(thr)).alias(m)
                              for (c, thr), m in mask_specs.items()])
    # running sums / counts (one Window operator)
    run_exprs = []
    for c in sum_cols:
        v = F.col(c).cast("double") - F.col(ref[c])
        # a running sum is NULL before the first value: prefix sums start from 0
        run_exprs += [F.coalesce(F.sum(v).over(run), F.lit(0.0)).alias(f"_S_{c}"),
                      F.coalesce(F.sum(v * v).over(run), F.lit(0.0)).alias(f"_Q_{c}")]
    for c in cnt_cols:
        run_exprs.append(F.count(F.col(c)).over(run).alias(f"_C_{c}"))
    for m in mask_specs.values():
        run_exprs.append(F.sum(F.col(m)).over(run).alias(f"_S_{m}"))
    if need_rows:
        run_exprs.append(F.count(F.lit(1)).over(run).alias("_R"))
    if run_exprs:
        df = df.select("*", *run_exprs)

    # doubling tables for max / min: one select per level for every column (each
    # level needs the previous one through a lag, so levels are separate Window nodes)
    tables = [("MX", c, top, F.greatest) for c, top in max_lv.items()] + \
             [("MN", c, top, F.least) for c, top in min_lv.items()]
    if tables:
        df = df.select("*", *[F.col(c).cast("double").alias(f"_{tag}1_{c}")
                              for tag, c, _, _ in tables])
        k = 1
        while any(k < top for _, _, top, _ in tables):
            nxt = [fn(F.col(f"_{tag}{k}_{c}"), F.lag(f"_{tag}{k}_{c}", k).over(w))
                   .alias(f"_{tag}{2 * k}_{c}") for tag, c, top, fn in tables if k < top]
            df = df.select("*", *nxt)
            k *= 2

    # ---- trailing windows ending at each row
    def full(c, n):
        return (F.col(f"_C_{c}") - F.lag(f"_C_{c}", n, 0).over(w)) == F.lit(n)

    def wsum(c, n):
        return F.col(f"_S_{c}") - F.lag(f"_S_{c}", n, 0.0).over(w)

    def wsq(c, n):
        return F.col(f"_Q_{c}") - F.lag(f"_Q_{c}", n, 0.0).over(w)

    def wext(c, n, tag):
        p = _pow2_floor(n)
        cur = F.col(f"_{tag}{p}_{c}")
        if p == n:
            return cur
        fn = F.greatest if tag == "MX" else F.least
        return fn(cur, F.lag(f"_{tag}{p}_{c}", n - p).over(w))

    def trailing(base, c, n):
        ok = full(c, n)
        if base == "sum":
            v = wsum(c, n) + F.lit(n) * F.col(ref[c])
        elif base == "mean":
            v = wsum(c, n) / F.lit(n) + F.col(ref[c])
        elif base in ("var", "std"):
            if n < 2:
                v = F.lit(None).cast("double")
            else:
                s = wsum(c, n)
                v = F.greatest((wsq(c, n) - s * s / F.lit(n)) / F.lit(n - 1), F.lit(0.0))
                if base == "std":
                    v = F.sqrt(v)
        elif base == "max":
            v = wext(c, n, "MX")
        elif base == "min":
            v = wext(c, n, "MN")
        elif base == "range":
            v = wext(c, n, "MX") - wext(c, n, "MN")
        else:
            raise ValueError(base)
        return F.when(ok, v)

    stage1, stage2, names_t = [], [], {}
    step = F.lit(step_hours)
    for f in feats:
        c = F.col(f.col) if f.col else None
        if f.op in TRAIL:
            base = "range" if f.op == "range" else f.op.split("_", 1)[1]
            stage1.append(trailing(base, f.col, f.n).alias(f.name))
        elif f.op in FWD or f.op == "next_max":
            base = "max" if f.op == "next_max" else f.op.split("_", 1)[1]
            t = f"_T_{base}_{f.col}_{f.n}"
            if t not in names_t:
                names_t[t] = trailing(base, f.col, f.n).alias(t)
            off = f.n if f.op == "next_max" else f.n - 1
            stage2.append(F.lead(t, off).over(w).alias(f.name) if off else F.col(t).alias(f.name))
        elif f.op == "lag":
            stage1.append(F.lag(f.col, f.n).over(w).alias(f.name))
        elif f.op == "diff_rate":
            stage1.append(((c - F.lag(f.col, 1).over(w)) / step).alias(f.name))
        elif f.op == "slope":
            stage1.append(((c - F.lag(f.col, f.n).over(w)) / F.lit(f.hours)).alias(f.name))
        elif f.op == "cum_diff":
            stage1.append((c - F.lag(f.col, f.n).over(w)).alias(f.name))
        elif f.op == "accel":
            d_now = (c - F.lag(f.col, 1).over(w)) / step
            d_then = (F.lag(f.col, f.n).over(w) - F.lag(f.col, f.n + 1).over(w)) / step
            stage1.append(((d_now - d_then) / F.lit(f.hours)).alias(f.name))
        elif f.op in ("hours_above", "count_above"):
            m = mask_specs[(f.col, f.thr)]
            ok = (F.col("_R") - F.lag("_R", f.n, 0).over(w)) == F.lit(f.n)
            s = F.col(f"_S_{m}") - F.lag(f"_S_{m}", f.n, 0).over(w)
            v = s * step if f.op == "hours_above" else s
            stage1.append(F.when(ok, v.cast("double")).alias(f.name))
    df = df.select("*", *stage1, *names_t.values())
    if stage2:
        df = df.select("*", *stage2)
    helpers += list(names_t)

    # ---- expressions evaluated per row after the windows
    post = []
    for f in feats:
        c = F.col(f.col) if f.col else None
        if f.op == "median_ratio":
            post.append(safe_div(c.cast("double"), F.col(pandas_names(f))).alias(f.name))
        elif f.op in ("median", "quantile", "pct_current"):
            post.append(F.col(pandas_names(f)).alias(f.name))
        elif f.op == "gt_quantile":
            post.append(flag(c > F.col(pandas_names(f))).alias(f.name))
        elif f.op == "product":
            post.append((c * F.col(f.col2)).alias(f.name))
        elif f.op == "flag_gt":
            post.append(flag(c > F.lit(f.thr)).alias(f.name))
        elif f.op == "expr":
            e = f.expr() if callable(f.expr) else f.expr
            post.append(e.alias(f.name))
    if post:
        df = df.select("*", *post)

    carry = [f for f in feats if f.op in CARRY]
    if carry:
        df = _carry_stage(df, layout, keys, part, carry, step_hours, w, run)

    out_cols = [c for c in base_cols if c not in (BUCKET, CORE)] if keep is None else list(keep)
    feat_names = list(dict.fromkeys(f.name for f in feats))
    return df.where(F.col(CORE)).select(*[col(n) for n in out_cols],
                                        *[col(n) for n in feat_names if n not in out_cols])


def _mask_of(f: Feat) -> Column:
    if f.op == "hours_since_nonzero":
        return F.coalesce(F.col(f.col), F.lit(0)) != F.lit(0)
    return falsey(F.col(f.col) > F.lit(f.thr))


def _carry_stage(df, layout, keys, part, feats, step_hours, w, run):
    """Unbounded-history features: in-bucket running state + carry from earlier buckets.

    The bucket summaries come from the layout itself, so that nothing above it runs twice."""
    summ = []
    for i, f in enumerate(feats):
        if f.op == "cumsum":
            summ.append(F.sum(F.col(f.col)).alias(f"_cs{i}"))
        else:
            summ.append(F.max(F.when(_mask_of(f), F.col(RN))).alias(f"_lt{i}"))
    s = layout.where(F.col(CORE)).groupBy(*part).agg(*summ)
    prev = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for i, f in enumerate(feats):
        if f.op == "cumsum":
            carry_cols.append(F.sum(f"_cs{i}").over(prev).alias(f"_ccs{i}"))
        else:
            carry_cols.append(F.max(f"_lt{i}").over(prev).alias(f"_clt{i}"))
    s = s.select(*part, *carry_cols)
    df = df.join(s, part, "left")
    out = []
    for i, f in enumerate(feats):
        if f.op == "cumsum":
            c = F.col(f.col)
            v = F.coalesce(F.col(f"_ccs{i}"), F.lit(0)) + F.sum(F.when(F.col(CORE), c)).over(run)
            out.append(F.when(c.isNotNull(), v).alias(f.name))
        else:
            last = F.greatest(F.max(F.when(_mask_of(f), F.col(RN))).over(run), F.col(f"_clt{i}"))
            out.append(((F.col(RN) - last) * F.lit(step_hours)).cast("double").alias(f.name))
    return df.select("*", *out)


# --------------------------------------------------------------------------- reference
def sliding_reference(df: DataFrame, keys, col: str, n: int, how: str,
                      order: str = RN) -> Column:
    """Plain sliding frame (O(n*w)) with the same full-window rule; for tests/small n."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    agg = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg,
           "std": F.stddev_samp, "var": F.var_samp}[how]
    return F.when(F.count(F.col(col)).over(w) == n, agg(F.col(col)).over(w))
