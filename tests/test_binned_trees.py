"""Boosting over counted cells is boosting over the rows; marks score as the trees do."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from flowrisk import session
from flowrisk.operators import models as ml
from flowrisk.operators import trees
from flowrisk.plans import selection

FEATS = ["a", "b", "c"]


def _rows(spark, n):
    i = F.col("id")
    d = spark.range(n).select(i.alias("row_idx"), *[F.round(F.rand(k), 2).alias(c) for k, c in enumerate(FEATS)])
    for c in FEATS:                                          # one cell has many rows
        d = d.withColumn(c, F.when(F.col("row_idx") % 4 == 0, 0.5).otherwise(F.col(c)))
    return d.withColumn("y", 4 * F.col("a") * F.col("b") + F.col("c") + F.rand(9)).cache()


@pytest.fixture(scope="module")
def rows(spark):
    d = _rows(spark, 8000)
    yield d
    d.unpersist()


def _x(d):
    return np.array(d.select(*FEATS).orderBy("row_idx").collect(), dtype=float).T


@pytest.mark.parametrize("limit", [session.ROWS_PER_TASK, 100])
def test_cells_give_the_fit_on_rows(rows, monkeypatch, limit):
    """Without draws the trees are MLlib's own; at 100 rows a task one cell is summed in pieces."""
    gbt = GBTRegressor(labelCol="y", maxIter=6, maxDepth=4, subsamplingRate=1.0, featureSubsetStrategy="0.8",
                       stepSize=0.1, seed=42).fit(ml.assemble(rows, FEATS))
    want = trees.of(gbt).predict(_x(rows))
    monkeypatch.setattr(session, "ROWS_PER_TASK", limit)
    got = trees.fit(rows, FEATS, "y", "row_idx", 8000, 42, 6, 4, subsampling=1.0)
    assert np.abs(got.predict(_x(rows)) - want).max() < 1e-9


def test_levels_read_cells(rows, monkeypatch):
    """A dealt table is not cached and read again for every level: the learner gets its cells.
    Drawn otherwise than MLlib draws, it fits as well."""
    few = rows.withColumn("b", F.lit(0.5)).withColumn("c", F.round("c", 1))
    x, y = _x(few), np.array(few.select("y").orderBy("row_idx").collect()).T[0]
    want = np.square(y - trees.of(ml.fit_regressor(few, FEATS, "y", max_iter=22)).predict(x)).mean()
    seen, fit = [], trees.RandomForestRegressor.fit
    monkeypatch.setattr(trees.RandomForestRegressor, "fit", lambda self, d: seen.append(d.count()) or fit(self, d))
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, d: pytest.fail("all rows were cached"))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    model = ml.fit_regressor(few, FEATS, "y", max_iter=22, order="row_idx", binned=True)
    assert len(seen) == 22 and max(seen) <= 32 * 12
    assert abs(np.square(y - model.predict(x)).mean() / want - 1) < 0.05


def test_draws(spark):
    """A round takes its share of the rows, by their numbers alone, and not another round's."""
    d = spark.range(100_000).select(trees.drawn(42, "id", 0.8).alias("x"), trees.drawn(43, "id", 0.8).alias("y"))
    n = d.agg(F.count_if("x"), F.count_if("y"), F.count_if(F.col("x") & F.col("y"))).first()
    assert all(abs(a - b) < 1000 for a, b in zip(n, (80_000, 80_000, 64_000), strict=True))


def test_crowded_days(spark, tmp_path, monkeypatch):
    """Days with more rows than a task should have are dealt by key; positions stay."""
    i = F.col("id")
    spark.range(5000).select(
        (i * 1000 % 5_000_011).alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.timestamp_seconds(F.when(i < 4000, 0).otherwise(i % 7 * 86400) + i % 3 * 3600).alias("l_shipdate"),
        *[(i % 7).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    lines = selection._ordered_lineitem(spark, str(tmp_path))
    got = [(r["l_shipdate"], r["l_orderkey"]) for r in lines.orderBy("row_idx").collect()]
    assert got == sorted(got) and len(got) == sum(1 for k in range(5000) if k % 7)     # no price per unit of nothing
    assert lines.agg(F.count_distinct("row_idx"), F.max("row_idx"), F.max("n_rows")).first() == (len(got), len(got) - 1, len(got))


def test_marks_score_as_the_model(rows):
    gbt = GBTRegressor(labelCol="y", maxIter=5, maxDepth=6, seed=1).fit(ml.assemble(rows, FEATS))
    fast = trees.of(gbt)
    want = gbt.transform(ml.assemble(rows, FEATS)).orderBy("row_idx").select("prediction").collect()
    x = _x(rows)
    assert np.abs(fast.predict(x) - np.array(want).T[0]).max() < 1e-12
    got = fast.transform(ml.assemble(rows, FEATS)).orderBy("row_idx").select("prediction").collect()
    assert np.abs(np.array(got) - np.array(want)).max() < 1e-12
    other = x[:, ::-1]
    for i, p in enumerate(fast.permuted(x, other)):
        mixed = [other[f] if f + 1 == i else x[f] for f in range(3)]
        assert np.array_equal(p, fast.predict(mixed))
