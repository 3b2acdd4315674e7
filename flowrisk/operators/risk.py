"""Risk output table.

Definitions (documented choices; the source describes them only in prose):
    risk_percent        = 100 * p
    risk_category       = low < 33.3 <= moderate < 66.7 <= high
    p_cso               = 100 * (1 + #{cso scores >= 1 - p}) / (n_cso + 1)
    p_safe              = 100 * (1 + #{safe scores >= p}) / (n_safe + 1)
    confidence_direction= 'CSO' if p_cso > p_safe else 'no CSO'
    confidence_percent  = max(p_cso, p_safe); NULL without calibration scores
    confidence_category = low < 50 <= moderate < 80 <= high
    trend               = rising / falling beyond a 1-point dead band vs the previous
                          grid step, stable otherwise and on the first row

``#{scores >= x}`` is a range count: ties are collapsed, the distinct values are cut into
balanced bins, the counts of higher bins come from a small bin table, and a running count
inside the bin gives the rest.  No score x query pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.operators.metrics import balanced_bins

# Fixed values of the documented choice:
RISK_BANDS = (33.3, 66.7)
CONFIDENCE_BANDS = (50.0, 80.0)
TREND_DEAD_BAND = 1.0


def count_at_least(queries: DataFrame, scores: DataFrame, group, qcol: str, scol: str,
                   out: str, bins: int = 128) -> DataFrame:
    """For every query row, the number of scores of its group with value >= ``qcol``.

    Scores and queries are collapsed to one row per distinct value; the values are cut
    into balanced bins.  A value's count is that of the higher bins (small table) plus
    the running count inside its own bin.
    """
    g = [group] if isinstance(group, str) else list(group)
    value = lambda c: F.col(c).cast("double").alias("_v")
    both = (scores.select(*g, value(scol), F.lit(1).alias("_n"))
            .unionByName(queries.select(*g, value(qcol), F.lit(0).alias("_n"))))
    c = both.where(F.col("_v").isNotNull()).groupBy(*g, "_v").agg(F.sum("_n").alias("_n"))
    c = balanced_bins(c, g, "_v", bins, "_b")
    after = Window.partitionBy(*g).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    higher = c.groupBy(*g, "_b").agg(F.sum("_n").alias("_bn")).select(
        *g, "_b", F.coalesce(F.sum("_bn").over(after), F.lit(0)).alias("_higher"))
    inbin = (Window.partitionBy(*g, "_b").orderBy(F.col("_v").desc())
             .rowsBetween(Window.unboundedPreceding, 0))
    total = c.withColumn("_c", F.sum("_n").over(inbin)).join(higher, g + ["_b"]).select(
        *g, "_v", (F.col("_higher") + F.col("_c")).alias(out))
    return (queries.withColumn("_v", F.col(qcol).cast("double")).join(total, g + ["_v"], "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_v"))


def category(v, bands, names=("low", "moderate", "high")):
    c = F.col(v) if isinstance(v, str) else v
    return F.when(c.isNull(), F.lit(None)).when(c < bands[0], names[0]) \
            .when(c < bands[1], names[1]).otherwise(names[2])


def risk_columns(df: DataFrame, p: str = "p") -> DataFrame:
    """risk_percent / category and the conformal confidence columns (needs n_cso,
    n_safe, cnt_cso, cnt_safe)."""
    pc = (1 + F.col("cnt_cso")) * 100.0 / (F.col("n_cso") + 1)
    ps = (1 + F.col("cnt_safe")) * 100.0 / (F.col("n_safe") + 1)
    has = (F.col("n_cso") > 0) | (F.col("n_safe") > 0)
    out = df.withColumn("risk_percent", F.col(p) * 100.0) \
            .withColumn("risk_category", category("risk_percent", RISK_BANDS)) \
            .withColumn("p_cso", F.when(has, pc)).withColumn("p_safe", F.when(has, ps))
    out = out.withColumn("confidence_direction",
                         F.when(has, F.when(F.col("p_cso") > F.col("p_safe"), F.lit("CSO"))
                                .otherwise(F.lit("no CSO"))))
    out = out.withColumn("confidence_percent", F.when(has, F.greatest("p_cso", "p_safe")))
    return out.withColumn("confidence_category", category("confidence_percent", CONFIDENCE_BANDS))


def trend(df: DataFrame, keys, time: str, step_seconds: int, value: str = "risk_percent") -> DataFrame:
    """Compare with the row one grid step earlier (equi-join on the shifted time)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    prev = df.select(*keys, (F.col(time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                              F.lit(step_seconds))).alias(time),
                     F.col(value).alias("_prev"))
    j = df.join(prev, keys + [time], "left")
    d = F.col(value) - F.col("_prev")
    return j.withColumn("trend", F.when(F.col("_prev").isNull(), "stable")
                        .when(d > TREND_DEAD_BAND, "rising").when(d < -TREND_DEAD_BAND, "falling")
                        .otherwise("stable")).drop("_prev")
