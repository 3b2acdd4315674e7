"""A model that shares another's probabilities has that model's very numbers, so their ranks tie."""

from pyspark.sql import functions as F

from flowrisk.operators.metrics import metric_table


def test_shared_metrics_are_copies(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("station"), (F.rand(1) > 0.5).cast("int").alias("y"), F.rand(2).alias("p"))
    models = F.explode(F.array(*map(F.lit, ("Persistence", "EnsembleClassifier", "ConformalEnsemble"))))
    d = d.withColumn("model", models).withColumn("pred", (F.col("p") > F.when(F.col("model") == "ConformalEnsemble", 0.6).otherwise(0.5)).cast("int"))
    t = metric_table(d, ["station"])
    assert "Union" not in t._jdf.queryExecution().optimizedPlan().toString()      # one computation, not one each
    got = {(r["station"], r["model"], r["metric"]): r["value"] for r in t.collect()}
    assert len(got) == 3 * 3 * 9
    for s in range(3):
        for m in ("MAE", "MSE", "Brier", "ROC_AUC", "PR_AUC"):
            assert got[s, "ConformalEnsemble", m] == got[s, "EnsembleClassifier", m]
        assert got[s, "ConformalEnsemble", "Recall"] < got[s, "EnsembleClassifier", "Recall"]
