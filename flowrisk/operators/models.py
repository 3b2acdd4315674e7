"""Distributed model fitting with MLlib.

* M7: one weighted gradient-boosted classifier per forward fold, pooled over the keys with
  the key among the features; positive weight ``max(neg,1)/max(pos,1)`` of the key's
  training rows in the fold (A5), seed ``seed + fold``; a fold whose training rows hold one
  class of a key is skipped for that key.
* M8: out-of-fold probability of every training row (NULL where no fold covers it).
* M9 / A16: mean probability of the usable fold models on the hold-out rows.
* M3: gradient-boosted regressor on all features; a table that the cores cannot take at once
  can be fitted on counted cells of binned rows (``trees.fit``).
* M4: permutation importance, one repeat: each feature column is replaced by the same
  column of a seeded row permutation (a join on distributed hash ranks), all permuted
  copies of a row are scored together and the R^2 drop is aggregated per feature (A13).

The fold loop runs on the driver over at most ``n_splits`` fits; every fit and every
transform is a distributed Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions.columns import col
from flowrisk.operators import cv, trees
from flowrisk.operators.metrics import positive_weight
from flowrisk.session import spread, tasks_needed


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="keep").transform(df)


def _prob(df: DataFrame, name: str = "p") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def fold_weights(df: DataFrame, key: str, n_splits: int, label: str = "y") -> DataFrame:
    """M7 + A5: per (key, fold) the class counts, ``weight`` of a positive row and ``usable``
    (both classes are there; a fold without them is skipped for that key)."""
    c = cv.fold_counts(df, key, n_splits, label)
    return c.withColumn("weight", positive_weight(F.col("n_pos"), F.col("n_neg"))) \
            .withColumn("usable", (F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def _usable(df: DataFrame, weights: DataFrame, key: str, fold: int) -> DataFrame:
    """Rows of the keys for which the fold is usable, with their positive weight."""
    w = weights.where((F.col("fold") == fold) & F.col("usable")).select(key, "weight")
    return df.join(w, key)


def fit_fold_models(df: DataFrame, weights: DataFrame, key: str, features: Sequence[str],
                    n_splits: int, seed: int = 42, max_iter: int = 500, max_depth: int = 6,
                    label: str = "y") -> dict:
    """M7: {fold: model}, each fitted on the fold's training rows of all usable keys.

    One pooled model per fold; the key is among the features, and every row is weighted by
    its own key's classes.  A fold that no key can use has no model.
    """
    used = {r["fold"] for r in weights.where("usable").select("fold").distinct().collect()}
    models = {}
    for fold in sorted(used):
        tr = assemble(_usable(cv.fold_part(df, n_splits, fold, "train"), weights, key, fold), features)
        tr = tr.withColumn("w", F.when(F.col(label) == 1, F.col("weight")).otherwise(F.lit(1.0)))
        gbt = GBTClassifier(labelCol=label, featuresCol="features", weightCol="w",
                            maxIter=max_iter, maxDepth=max_depth, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", stepSize=0.1, seed=seed + fold)
        models[fold] = gbt.fit(tr.select("features", label, "w"))
    return models


def out_of_fold(df: DataFrame, weights: DataFrame, models: dict, key: str, features: Sequence[str],
                n_splits: int, row_keys: Sequence[str]) -> DataFrame:
    """M8: probability of each validation row from the model of its fold."""
    out = df.sparkSession.createDataFrame([], df.select(*row_keys).schema.add("p", "double"))
    for fold, m in models.items():
        val = assemble(_usable(cv.fold_part(df, n_splits, fold, "val"), weights, key, fold), features)
        out = out.unionByName(_prob(m.transform(val)).select(*row_keys, "p"))
    return out


def ensemble_predict(test: DataFrame, weights: DataFrame, models: dict, key: str,
                     features: Sequence[str], row_keys: Sequence[str]) -> DataFrame:
    """Mean probability of the fold models that are usable for the row's key
    (``p_ens``, ``n_models``); keys without a usable fold have no row."""
    out = test.sparkSession.createDataFrame([], test.select(*row_keys).schema.add("p", "double"))
    for fold, m in models.items():
        out = out.unionByName(_prob(m.transform(assemble(_usable(test, weights, key, fold), features)))
                              .select(*row_keys, "p"))
    return cv.ensemble_mean(out, row_keys)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, seed: int = 42,
                  max_iter: int = 500, max_depth: int = 6, order: str | None = None, binned: bool = False):
    """M3: gradient-boosted regressor on all features.

    The fit caches one block of rows per task and reads it for every tree level.  ``order``, a
    0-based position over all rows, deals a table that the cores cannot take at once out to as
    many tasks as it needs, by blocks of positions and sorted, so that every run samples alike.
    With ``binned`` such a table is not cached and read by level, but counted into cells of
    binned rows once, and all levels read the cells (``trees.fit``; each round draws its rows by position).
    """
    rows = train.count() if order else 0
    n = tasks_needed(train.sparkSession, rows)
    if n is not None and binned and max_depth <= trees.DEPTH:
        return trees.fit(train, features, label, order, rows, seed, max_iter, max_depth)
    if n is not None:
        train = train.repartition(n, F.floor(col(order) / 4096)).sortWithinPartitions(order)
    gbt = GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter,
                       maxDepth=max_depth, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                       stepSize=0.1, seed=seed)
    return gbt.fit(assemble(train, features))


def r2(df: DataFrame, group: Sequence[str], y: str, p: str) -> DataFrame:
    """``1 - SSE / SST`` per group (one pass: sums of y, y^2 and squared errors)."""
    a = df.groupBy(*group).agg(F.sum((col(y) - col(p)) ** 2).alias("_sse"),
                               F.sum(col(y)).alias("_sy"), F.sum(col(y) ** 2).alias("_syy"),
                               F.count(F.lit(1)).alias("_n"))
    sst = F.col("_syy") - F.col("_sy") ** 2 / F.col("_n")
    return a.select(*group, (1 - F.try_divide(F.col("_sse"), sst)).alias("r2"))


def permutation_importance(model, data: DataFrame, features: Sequence[str], label: str,
                           row_keys: Sequence[str], seed: int = 42) -> DataFrame:
    """M4: R^2 drop when one feature column is replaced by a seeded permutation of it.

    ``row_keys`` identify a row.  Every row is scored.  The permutation pairs the i-th row
    in one seeded hash order with the i-th in another; both ranks come from counts per hash
    range (``cv.ordinal``), so no task orders all rows, and tasks are as many as the rows need.
    """
    feats = list(features)
    n_rows = data.count()

    def ranked(s: int, df: DataFrame) -> DataFrame:
        d = df.withColumn("_hash", F.xxhash64(F.lit(s), *row_keys))
        return cv.ordinal(d, [], ["_hash", *row_keys], F.shiftright("_hash", 52), "_pos", rows=n_rows).drop("_hash", "n_rows")

    by_row = ranked(seed, data)
    other = ranked(seed + 1, data).select("_pos", *[col(f).alias(f"_perm_{f}") for f in feats])
    if tasks_needed(data.sparkSession, n_rows) is not None:
        by_row, other = spread(by_row, n_rows, "_pos"), spread(other, n_rows, "_pos")
    j = by_row.join(other, "_pos")
    scorer = trees.of(model)
    if scorer is not None:
        scored = trees.permuted_scores(scorer, j, label, feats, [f"_perm_{f}" for f in feats])
        s = r2(scored, ["copy"], "y", "prediction")
        names = F.array(F.lit("__none__"), *map(F.lit, feats))
        s = s.select(F.element_at(names, F.col("copy") + 1).alias("feature"), "r2")
    else:
        s = r2(_walked(model, j, feats, label), ["feature"], label, "prediction")
    # over the few rows of the result: a join of two parts of it would score everything twice
    plain = F.max(F.when(F.col("feature") == "__none__", F.col("r2"))).over(Window.partitionBy())
    return s.withColumn("_ref", plain).where(F.col("feature") != "__none__") \
        .select("feature", (F.col("_ref") - F.col("r2")).alias("importance"))


def _walked(model, paired: DataFrame, feats: list[str], label: str) -> DataFrame:
    """Every copy of every row as a row, scored by the model; for trees too large for ``trees``."""
    base = F.array(F.struct(F.lit("__none__").alias("feature"),
                            *[col(f).alias(f) for f in feats]))
    perm = [F.struct(F.lit(f).alias("feature"),
                     *[(F.col(f"_perm_{g}") if g == f else col(g)).alias(g) for g in feats])
            for f in feats]
    rows = paired.select(label, F.explode(F.concat(base, F.array(*perm))).alias("_x")) \
                 .select(label, "_x.*")
    return model.transform(assemble(rows, feats)).select("feature", label, "prediction")
