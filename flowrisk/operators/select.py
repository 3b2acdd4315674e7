"""Feature selection.

* A14: absolute Pearson correlation of every feature pair in one pass over the rows
  (co-moment matrices per task, merged by a grouped sum).
* M5: keep features whose importance exceeds ``frac * max(importance)``.
* M6: features linked by ``|corr| >= threshold`` form groups (connected components),
  found by min-label propagation with pointer jumping, to convergence; each round cuts
  lineage with ``checkpoint()`` into the session's checkpoint folder.
* T3 / T4: the most important member of each group is kept; kept features are ranked
  by importance.
* T5: a reproducible sample of at most ``n`` rows, ordered by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrisk.functions.columns import attach_scalars, col
from flowrisk.session import checkpoint_dir, stage


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(a, b, abs_corr)`` for every pair a < b (by position in ``features``).

    Pairwise-complete Pearson correlation (rows where either value is NULL or NaN do not
    count for the pair).  One pass over the rows, whatever the number of features: each
    task forms the co-moments of all pairs around its own means by matrix products, and
    these are merged exactly (counts, means and co-moments of the parts).  NULL where a
    pair has no row or no variance.
    """
    feats = list(features)
    k = len(feats)
    names = ["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"]
    upper = np.triu_indices(k, 1)

    def moments(batches):
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            has = np.isfinite(x).astype(float)
            shift = np.nansum(np.where(has > 0, x, 0), axis=0) / np.maximum(has.sum(axis=0), 1)
            x = np.where(has > 0, x - shift, 0.0)
            n, sx = has.T @ has, x.T @ has            # sx[i, j]: sum of i where j has a value
            some = np.maximum(n, 1)
            sq = (x * x).T @ has
            cxx, cxy = sq - sx * sx / some, x.T @ x - sx * sx.T / some
            mean = sx / some + shift[:, None]
            i, j = upper
            out = [i, j, n[i, j].astype(np.int64), mean[i, j], mean[j, i], cxx[i, j], cxx[j, i], cxy[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    wide = df.select(*[col(f).cast("double").alias(f"c{i}") for i, f in enumerate(feats)])
    part = stage(wide.mapInArrow(moments, "i long, j long, n long, mx double, my double, cxx double, "
                                          "cyy double, cxy double").where("n > 0"), "moments")
    mean = part.groupBy("i", "j").agg((F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("gx"),
                                      (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("gy"))
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    total = part.join(mean, ["i", "j"]).groupBy("i", "j").agg(
        F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("vx"),
        F.sum(F.col("cyy") + F.col("n") * dy * dy).alias("vy"),
        F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("v"))
    name = F.array(*[F.lit(f) for f in feats])
    pairs = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(int(i)).cast("long").alias("i"), F.lit(int(j)).cast("long").alias("j"))
        for i, j in zip(*upper)])))                       # every pair, also those without a row
    r = F.try_divide(F.col("v"), F.sqrt(F.col("vx")) * F.sqrt(F.col("vy")))
    return pairs.join(total, ["i", "j"], "left").select(
        F.element_at(name, (F.col("i") + 1).cast("int")).alias("a"),
        F.element_at(name, (F.col("j") + 1).cast("int")).alias("b"), F.abs(r).alias("abs_corr"))


def importance_filter(imp: DataFrame, frac: float = 0.05, feature: str = "feature",
                      importance: str = "importance") -> DataFrame:
    """M5: features with importance strictly above ``frac`` times the largest one."""
    mx = imp.agg(F.max(importance).alias("_mx"))
    return attach_scalars(imp, mx).where(
        F.col(importance) > F.lit(frac) * F.col("_mx")).drop("_mx")


def connected_components(spark: SparkSession, nodes: DataFrame, edges: DataFrame,
                         node: str = "feature") -> DataFrame:
    """M6: label every node with the smallest node id of its component.

    ``nodes`` has column ``node``; ``edges`` has columns ``a``, ``b`` (undirected).  Every
    round takes the least label among a node and its neighbours, hands it to the node's
    old label as well, and jumps to the label's label, so that a long chain needs rounds
    in the logarithm of its length.  The loop ends when no label changes.
    """
    checkpoint_dir(spark)
    und = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab = nodes.select(F.col(node).alias("v"), F.col(node).alias("label"))
    while True:
        near = und.join(lab.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")) \
                  .agg(F.min("label").alias("_nl"))
        least = lab.join(near, "v", "left").select(
            "v", "label", F.least(F.col("label"), F.coalesce("_nl", "label")).alias("_l"))
        hooked = least.select("v", "_l").unionByName(least.select(F.col("label").alias("v"), "_l")) \
                      .groupBy("v").agg(F.min("_l").alias("_l"))
        jump = hooked.select(F.col("v").alias("_l"), F.col("_l").alias("_ll"))
        new = hooked.join(jump, "_l").select("v", F.least("_l", "_ll").alias("label")).checkpoint()
        changed = new.join(lab.withColumnRenamed("label", "_old"), "v") \
                     .where(F.col("label") != F.col("_old")).limit(1).count()
        lab = new
        if changed == 0:
            return lab.select(F.col("v").alias(node), F.col("label").alias("group"))


def group_representatives(groups: DataFrame, imp: DataFrame, feature: str = "feature",
                          importance: str = "importance") -> DataFrame:
    """T3 + T4: most important feature of every group, ranked by importance."""
    j = groups.join(imp, feature)
    best = j.groupBy("group").agg(F.max_by(feature, F.struct(importance, F.col(feature))).alias(feature),
                                  F.max(importance).alias(importance))
    w = Window.orderBy(F.col(importance).desc(), F.col(feature))
    # the kept list is at most the number of features: a global rank is fine here
    return best.withColumn("rank", F.row_number().over(w))


def seeded_sample(df: DataFrame, n: int, seed: int, key_cols: Sequence[str]) -> DataFrame:
    """T5: at most ``n`` rows, those with the least MD5 of the seed and ``key_cols``.

    Rows are counted by the hash's first four digits (65,536 counts at most); the final order
    sees those up to the digits that the ``n``-th row has, ``n`` and one such bin at most, and
    not ``n`` rows of every task.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in key_cols]).cast("binary"))
    hashed = df.withColumn("_h", h)
    head = F.substring("_h", 1, 4)
    cut, seen = None, 0
    for r in sorted(hashed.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).collect()):
        cut, seen = r["head"], seen + r["n"]
        if seen >= n:
            break
    if cut is not None:
        hashed = hashed.where(head <= cut)
    return hashed.orderBy("_h", *key_cols).limit(n).drop("_h")
