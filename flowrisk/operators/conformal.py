"""Split-conformal calibration of exceedance probabilities.

Nonconformity of an out-of-fold prediction is ``1 - p`` for a positive and ``p`` for a
negative.  With n scores and miscoverage ``alpha`` the quantile level is
``min(1, ceil((n + 1)(1 - alpha)) / n)`` and ``q_hat`` is the order statistic with
0-based index ``ceil(level * (n - 1))`` (numpy ``method="higher"``).  The conformal
decision threshold is ``1 - q_hat``.  Calibration is only built when both classes
are present; otherwise the threshold is NULL and decisions fall back to ``p >= 0.5``.

The order statistic is found without sorting a whole group in one task: scores are
counted per (group, balanced value bin); the bin holding the k-th value is located from the
prefix counts of the small bin table, and only that bin is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.operators.metrics import balanced_bins, decide


def _g(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def nonconformity(y: str = "y", p: str = "p"):
    """``1 - p`` for positives, ``p`` for negatives."""
    return F.when(F.col(y) == 1, 1.0 - F.col(p)).otherwise(F.col(p))


def quantile_level(n, alpha: float):
    """A15 level ``min(1, ceil((n + 1) * (1 - alpha)) / n)`` as a Column."""
    return F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1.0 - alpha)) / n)


def kth_smallest(df: DataFrame, group, value: str, k: DataFrame, k_col: str = "k",
                 bins: int = 128) -> DataFrame:
    """Per group, the value at 0-based position ``k`` of the sorted values.

    ``k`` holds one row per group with column ``k_col``.
    """
    g = _g(group)
    c = df.groupBy(*g, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    c = balanced_bins(c, g, "_v", bins, "_b")
    bc = c.groupBy(*g, "_b").agg(F.sum("_c").alias("_bc"))
    upto = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bc = bc.withColumn("_cum", F.sum("_bc").over(upto))
    bc = bc.join(k.select(*g, F.col(k_col).alias("_k")), g)
    # the bin where the cumulative count first exceeds k
    target = bc.where((F.col("_cum") > F.col("_k")) & (F.col("_cum") - F.col("_bc") <= F.col("_k")))
    target = target.select(*g, "_b", (F.col("_k") - (F.col("_cum") - F.col("_bc"))).alias("_kk"))
    inb = c.join(target, g + ["_b"])
    w = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inb = inb.withColumn("_run", F.sum("_c").over(w))
    hit = inb.where((F.col("_run") > F.col("_kk")) & (F.col("_run") - F.col("_c") <= F.col("_kk")))
    return hit.select(*g, F.col("_v").alias(value))


def conformal_threshold(oof: DataFrame, group, alpha: float, y: str = "y",
                        p: str = "p") -> DataFrame:
    """Per group ``n_scores``, ``q_level``, ``q_hat`` and ``conf_threshold``.

    Groups with a single class get NULL ``q_hat`` / ``conf_threshold`` (M12).
    """
    g = _g(group)
    sc = oof.where(F.col(p).isNotNull()).select(*g, y, nonconformity(y, p).alias("_s"))
    stats = sc.groupBy(*g).agg(F.count(F.lit(1)).alias("n_scores"),
                               F.sum(y).cast("long").alias("_pos"))
    n = F.col("n_scores")
    lvl = quantile_level(n, alpha)
    # numpy 'higher': index ceil(level * (n - 1)) on the sorted scores
    stats = stats.withColumn("q_level", lvl).withColumn(
        "k", F.ceil(F.col("q_level") * (n - 1)).cast("long"))
    both = stats.where((F.col("_pos") > 0) & (F.col("_pos") < n))
    q = kth_smallest(sc, g, "_s", both, "k")
    out = stats.join(q, g, "left").withColumnRenamed("_s", "q_hat")
    ok = (F.col("_pos") > 0) & (F.col("_pos") < n)
    return out.select(*g, "n_scores", "q_level",
                      F.when(ok, F.col("q_hat")).alias("q_hat"),
                      F.when(ok, 1.0 - F.col("q_hat")).alias("conf_threshold"))


def conformal_decision(p: str = "p", conf_threshold: str = "conf_threshold"):
    """``p >= conf_threshold``, or ``p >= 0.5`` when no calibration exists."""
    return F.when(F.col(conf_threshold).isNotNull(), decide(p, F.col(conf_threshold))) \
            .otherwise(decide(p, 0.5))
