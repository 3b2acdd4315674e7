"""Forecast-quality metrics as grouped aggregations.

All metrics are computed for many groups (station x horizon x model) at once.

* MAE / MSE / Brier / confusion counts: one grouped aggregation (partial agg).
* precision / recall / F1 with ``zero_division=0``; specificity NULL without negatives.
* ROC AUC: Mann-Whitney statistic with ties counted one half (equal to the
  trapezoidal ROC area); NULL when a class is missing.
* Average precision: sum over distinct scores (descending) of
  ``(recall_k - recall_{k-1}) * precision_k``; 0 without positives.

AUC / AP need, for every distinct score, the number of positives and negatives with
a strictly smaller score.  Ties are collapsed first (``groupBy(group, score)``), then
the distinct scores are cut into ``bins`` of nearly equal size at splitters from a
mergeable quantile sketch per group: prefix counts run inside each (group, bin) window
and the counts of earlier bins come from a small bin table.  No window ever spans a
whole group, and scores that crowd near 0 still spread over all bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions.columns import clip

METRICS = ("MAE", "MSE", "Brier", "PR_AUC", "ROC_AUC", "Precision", "Recall", "F1",
           "Specificity")
LOWER_BETTER = ("MAE", "MSE", "Brier")
HIGHER_BETTER = ("PR_AUC", "ROC_AUC", "Precision", "Recall", "F1", "Specificity")


def _g(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def exceed(target: str | Column, threshold: float) -> Column:
    """Strict exceedance label ``target > threshold`` as 0/1 (NULL target -> NULL)."""
    t = F.col(target) if isinstance(target, str) else target
    return (t > F.lit(threshold)).cast("int")


def decide(prob: str | Column, threshold: float | Column = 0.5) -> Column:
    """Inclusive decision ``p >= threshold`` as 0/1."""
    p = F.col(prob) if isinstance(prob, str) else prob
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (p >= thr).cast("int")


def persistence_prob(value: str | Column) -> Column:
    """Persistence probability = current value clipped to [0, 1]."""
    return clip(F.col(value) if isinstance(value, str) else value, 0.0, 1.0)


def regression_metrics(df: DataFrame, group, y: str, p: str) -> DataFrame:
    """MAE and MSE of a continuous forecast."""
    e = F.col(p).cast("double") - F.col(y).cast("double")
    return df.groupBy(*_g(group)).agg(F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"))


def class_counts(df: DataFrame, group) -> DataFrame:
    """A4: rows, positives and distinct classes per group (one-class test)."""
    return df.groupBy(*_g(group)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"),
        F.countDistinct("y").alias("n_classes"))


def positive_weight(n_pos: Column, n_neg: Column) -> Column:
    """A5: ``max(neg, 1) / max(pos, 1)``."""
    return F.greatest(n_neg, F.lit(1)).cast("double") / F.greatest(n_pos, F.lit(1))


def balanced_bins(distinct: DataFrame, group, value: str, bins: int = 128,
                  name: str = "_bin") -> DataFrame:
    """``distinct`` (one row per group and value) plus a bin that is non-decreasing in the
    value; the bins of a group hold nearly equal numbers of rows."""
    g = _g(group)
    at = [i / bins for i in range(1, bins)]
    cuts = distinct.groupBy(*g).agg(
        F.array_distinct(F.percentile_approx(value, at, F.lit(50 * bins))).alias("_cuts"))
    v = F.col(value)
    return (distinct.join(cuts, g)
            .withColumn(name, F.size(F.filter("_cuts", lambda c: c < v)).cast("long")).drop("_cuts"))


def rank_counts(df: DataFrame, group, y: str, score: str, bins: int = 128) -> DataFrame:
    """Per (group, distinct score): pos, neg and counts of pos/neg with smaller scores."""
    g = _g(group)
    c = (df.where(F.col(score).isNotNull())
         .groupBy(*g, F.col(score).cast("double").alias("_s"))
         .agg(F.sum(F.col(y)).cast("long").alias("_pos"),
              F.sum(1 - F.col(y)).cast("long").alias("_neg")))
    c = balanced_bins(c, g, "_s", bins)
    sums = c.groupBy(*g, "_bin").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    before = Window.partitionBy(*g).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*g, "_bin",
                       F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_cp"),
                       F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_cn"))
    inbin = Window.partitionBy(*g, "_bin").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(sums, g + ["_bin"])
    return c.select(*g, "_s", "_pos", "_neg",
                    (F.col("_cp") + F.coalesce(F.sum("_pos").over(inbin), F.lit(0))).alias("_lt_pos"),
                    (F.col("_cn") + F.coalesce(F.sum("_neg").over(inbin), F.lit(0))).alias("_lt_neg"))


def rank_metrics(df: DataFrame, group, y: str, score: str) -> DataFrame:
    """A11 ROC AUC and A12 average precision per group."""
    g = _g(group)
    rc = rank_counts(df, g, y, score)
    tot = rc.groupBy(*g).agg(F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nn"))
    rc = rc.join(tot, g)
    tp = F.col("_np") - F.col("_lt_pos")
    fp = F.col("_nn") - F.col("_lt_neg")
    auc_part = F.col("_pos") * (F.col("_lt_neg") + F.lit(0.5) * F.col("_neg"))
    ap_part = F.col("_pos") * tp / (tp + fp)   # divided by the positives once, below
    out = rc.groupBy(*g, "_np", "_nn").agg(F.sum(auc_part).alias("_auc"),
                                            F.sum(F.when(F.col("_pos") > 0, ap_part)).alias("_ap"))
    return out.select(
        *g,
        F.when((F.col("_np") > 0) & (F.col("_nn") > 0),
               F.col("_auc") / (F.col("_np") * F.col("_nn"))).alias("ROC_AUC"),
        F.when(F.col("_np") > 0, F.coalesce(F.col("_ap"), F.lit(0.0)) / F.col("_np"))
        .otherwise(F.lit(0.0)).alias("PR_AUC"))


def prob_metrics(df: DataFrame, group, y: str = "y", p: str = "p") -> DataFrame:
    """Probability metrics per group: MAE, MSE, Brier (A6, A7), ROC AUC, AP."""
    g = _g(group)
    e = F.col(p).cast("double") - F.col(y)
    base = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("MAE"),
                              F.avg(e * e).alias("MSE"), F.avg(e * e).alias("Brier"))
    return base.join(rank_metrics(df.select(*g, y, p), g, y, p), g, "left")


def decision_metrics(df: DataFrame, group, y: str = "y", pred: str = "pred") -> DataFrame:
    """Decision metrics per group: confusion counts with labels [0, 1] (A8), precision,
    recall, F1 with zero_division=0 (A9), specificity NULL without negatives (A10)."""
    g = _g(group)
    yy, dd = F.col(y), F.col(pred)
    base = df.groupBy(*g).agg(
        F.count_if((yy == 1) & (dd == 1)).alias("tp"), F.count_if((yy == 0) & (dd == 1)).alias("fp"),
        F.count_if((yy == 1) & (dd == 0)).alias("fn"), F.count_if((yy == 0) & (dd == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return base.select(
        "*",
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("Precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("Recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("F1"),
        F.try_divide(tn, tn + fp).alias("Specificity"))


def binary_metrics(df: DataFrame, group, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """All nine exceedance metrics plus confusion counts per group."""
    g = _g(group)
    return prob_metrics(df, g, y, p).join(decision_metrics(df, g, y, pred), g)


def metric_long(wide: DataFrame, group, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide metric columns -> (group..., metric, value) rows, NULLs kept."""
    g = _g(group)
    return wide.select(*g, *metrics).unpivot(g, list(metrics), "metric", "value")


def metric_table(scored: DataFrame, group, model_col: str = "model",
                 shares_prob: dict[str, str] | None = None) -> DataFrame:
    """Exceedance metrics per (group, model), long with a ``section`` column.

    ``scored`` has columns group..., model, y, p, pred.  Models listed in
    ``shares_prob`` (model -> source model) reuse the probability metrics of their
    source (the conformal variant only changes the decision rule), so shared values
    are identical and computed once.
    """
    shares_prob = {"ConformalEnsemble": "EnsembleClassifier"} if shares_prob is None else shares_prob
    g = _g(group)
    own = scored.where(~F.col(model_col).isin(*shares_prob)) if shares_prob else scored
    pm = prob_metrics(own, g + [model_col]).drop("n")
    if shares_prob:     # copies of the computed row: a second plan would sum in another order, and ties would break
        also = [F.when(F.col(model_col) == src, F.lit(tgt)) for tgt, src in shares_prob.items()]
        pm = pm.withColumn(model_col, F.explode(F.array_compact(F.array(F.col(model_col), *also))))
    dm = decision_metrics(scored, g + [model_col])
    wide = pm.join(dm, g + [model_col])
    return metric_long(wide, g + [model_col]).withColumn("section", F.lit("exceedance_metrics"))
