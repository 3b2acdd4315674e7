"""Training runs whose stations cannot use any fold."""

import uuid

from flowrisk.plans import model_runs as mr
from flowrisk.session import checkpoint_dir


def test_one_class_horizon_is_scored(spark):
    """No fold is usable, so no model, score or threshold is stored; every row gets its persistence."""
    rows = [(k, i, float(i), 0.75, 1, i >= 32, 32, 1.0, 0.75) for k in ("a", "b") for i in range(40)]
    d = spark.createDataFrame(rows, "event_type string, row_idx long, time double, fill_ratio double, y int, "
                                    "is_test boolean, n_train long, station_no double, f0 double")
    root = f"{checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    assert mr.fit_horizon(d, ["f0"], root, 6, 1, 1).count() == 0
    out = mr.model_rows(d, root, 6).collect()
    assert len(out) == 2 * 8 * 3
    assert {(r["station_id"], r["p"], r["n_models"]) for r in out} == {("a", 0.75, None), ("b", 0.75, None)}
    assert mr.registry.finished(spark, root).count() == 2
    folds = mr.registry.stored_folds(spark, root)
    assert folds.count() == 10 and folds.where("usable").count() == 0


def test_registry_without_any_run(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    assert mr.registry.finished(spark, root).count() == 0
    assert mr.registry.stored_folds(spark, root).count() == mr.registry.stored_thresholds(spark, root).count() == 0
