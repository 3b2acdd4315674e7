"""Temporal splits (W18, M1, M2) and fold ensembles.

Row ordinals per key are computed without a window over the whole key: rows are
counted per (key, time bucket), the counts are prefix-summed over the small bucket
table, and a ``row_number`` inside each (key, bucket) adds the local position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.session import spread, tasks_needed


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ordinal(df: DataFrame, keys, order, bucket: Column, name: str = "row_idx",
            outer: Column | None = None, rows: int | None = None) -> DataFrame:
    """0-based position of each row within its key by ``order`` (a column or several).

    ``bucket`` must be non-decreasing in ``order`` (e.g. ``floor(rn / B)`` or a month).
    Adds ``name`` and ``n_rows`` (rows of the key).  ``outer`` is a coarser, non-null bucket of
    the buckets, for tables where these are too many for one window: they are summed within
    it, and only its own counts per key go through one window.  ``rows`` (counted) spreads
    the rows over as many tasks as they need; with few rows neither is done.
    """
    keys = _k(keys)
    if rows is not None and tasks_needed(df.sparkSession, rows) is None:
        outer, rows = None, None
    d = df.withColumn("_ob", bucket)
    top = [] if outer is None else ["_oo"]
    if top:
        d = d.withColumn("_oo", outer)
    cnt = d.groupBy(*keys, *top, "_ob").agg(F.count(F.lit(1)).alias("_c"))
    prior = lambda by, o: Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    allk = Window.partitionBy(*keys)
    off = F.coalesce(F.sum("_c").over(prior([*keys, *top], "_ob")), F.lit(0))
    if top:
        outers = cnt.groupBy(*keys, "_oo").agg(F.sum("_c").alias("_n"))
        outers = outers.select(*keys, "_oo", F.coalesce(F.sum("_n").over(prior(keys, "_oo")), F.lit(0)).alias("_before"),
                               F.sum("_n").over(allk).alias("n_rows"))
        cnt = cnt.select(*keys, "_oo", "_ob", off.alias("_off")).join(outers, [*keys, "_oo"])
        cnt = cnt.select(*keys, "_ob", (F.col("_before") + F.col("_off")).alias("_off"), "n_rows")
        d = d.drop("_oo")
    else:
        cnt = cnt.select(*keys, "_ob", off.alias("_off"), F.sum("_c").over(allk).alias("n_rows"))
    if rows is not None:                           # rows stay in their tasks, unsorted; the counts come to them
        d, cnt = spread(d, rows, *keys, "_ob"), cnt.hint("shuffle_hash")
    d = d.join(cnt, keys + ["_ob"])                # with no keys, positions over all rows
    w = Window.partitionBy(*keys, "_ob").orderBy(*_k(order))
    return d.withColumn(name, F.col("_off") + F.row_number().over(w) - 1).drop("_ob", "_off")


def holdout(df: DataFrame, test_frac: float, idx: str = "row_idx", n: str = "n_rows",
            name: str = "is_test") -> DataFrame:
    """M1: the first ``int(n * (1 - test_frac))`` rows of each key train, the rest test."""
    split = F.floor(F.col(n) * F.lit(1.0 - test_frac)).cast("long")
    return df.withColumn("n_train", split).withColumn(name, F.col(idx) >= F.col("n_train"))


def fold_roles(df: DataFrame, n_splits: int, idx: str = "row_idx", n: str = "n_train") -> DataFrame:
    """M2: forward-chaining folds on the training rows (``idx < n``).

    ``test_size = n // (k + 1)``; fold i (1..k) validates rows
    ``[n - (k - i + 1) * ts, n - (k - i) * ts)`` and trains on every earlier row.  Each
    training row is exploded to (fold, role) pairs: role 'val' for its validation
    fold, 'train' for every later fold.
    """
    k = n_splits
    ts = F.floor(F.col(n) / F.lit(k + 1)).cast("long")
    first_start = F.col(n) - F.lit(k) * ts
    r = F.col(idx)
    # validation fold of the row (None before the first validation block)
    vf = F.when(r >= first_start, F.floor((r - first_start) / ts).cast("int") + 1)
    # the row trains every fold whose validation starts after it
    first_train = F.when(r < first_start, F.lit(1)).otherwise(vf + 1)
    folds = F.when(ts > 0, F.sequence(first_train.cast("int"), F.lit(k)))
    rows = df.where(r < F.col(n))
    tr = rows.where(first_train <= k).select("*", F.explode(folds).alias("fold")) \
             .withColumn("role", F.lit("train"))
    va = rows.where(vf.isNotNull() & (ts > 0)).withColumn("fold", vf).withColumn("role", F.lit("val"))
    return tr.unionByName(va)


def _fold_bounds(k: int, fold: Column, n: str) -> tuple[Column, Column, Column]:
    ts = F.floor(F.col(n) / F.lit(k + 1)).cast("long")
    return F.col(n) - (k - fold + 1) * ts, F.col(n) - (k - fold) * ts, ts


def fold_part(df: DataFrame, n_splits: int, fold: int, role: str, idx: str = "row_idx",
              n: str = "n_train") -> DataFrame:
    """M2: the training ('train') or validation ('val') rows of one forward fold, as a range
    of ordinals; nothing is copied."""
    start, end, ts = _fold_bounds(n_splits, F.lit(fold), n)
    part = F.col(idx) < start if role == "train" else (F.col(idx) >= start) & (F.col(idx) < end)
    return df.where((ts > 0) & part)


def fold_counts(df: DataFrame, keys, n_splits: int, label: str = "y", idx: str = "row_idx",
                n: str = "n_train") -> DataFrame:
    """Per key and fold: ``n_train_rows``, ``n_pos``, ``n_neg`` and ``n_val`` (zeros included).

    One pass: rows are counted per key and block (the block that they validate, 0 before
    the first), and a fold trains on the blocks before its own.
    """
    keys = _k(keys)
    ts = F.floor(F.col(n) / F.lit(n_splits + 1)).cast("long")
    first = F.col(n) - F.lit(n_splits) * ts
    block = F.when(F.col(idx) < first, F.lit(0)).otherwise(F.floor((F.col(idx) - first) / ts).cast("int") + 1)
    blocks = df.where((F.col(idx) < F.col(n)) & (ts > 0)).groupBy(*keys, block.alias("block")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("pos"))
    fold = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold")
    each = blocks.select(*keys, "block", "rows", "pos", fold)
    before = F.col("block") < F.col("fold")
    total = lambda c: F.sum(F.when(before, F.col(c)).otherwise(0)).cast("long")
    out = each.groupBy(*keys, "fold").agg(
        total("rows").alias("n_train_rows"), total("pos").alias("n_pos"),
        F.sum(F.when(F.col("block") == F.col("fold"), F.col("rows")).otherwise(0)).cast("long").alias("n_val"))
    return out.withColumn("n_neg", F.col("n_train_rows") - F.col("n_pos"))


def ensemble_mean(pred: DataFrame, row_keys, p: str = "p", name: str = "p_ens") -> DataFrame:
    """Mean probability over the fold models for each row."""
    return pred.groupBy(*_k(row_keys)).agg(F.avg(p).alias(name), F.count(p).alias("n_models"))
