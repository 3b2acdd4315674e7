"""Feature catalogue: value-level agreement with plain SQL sliding windows, and
independence of the halo bucket size."""

import math

from tests.conftest import SF
from tests.oracle import duck_rows, spark_rows


def _close(a, b, tol):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=tol)
    return a == b


COARSE = {"fill_ratio_std_1h", "rainfall_variance_1h"}  # rounded to 4 digits


def _compare(r1, r2, cols):
    """Equal up to one unit in the last rounded digit (ties may round either way)."""
    bad = {}
    for a, b in zip(r1, r2):
        for i, (x, y) in enumerate(zip(a, b)):
            tol = 1.01e-4 if cols[i] in COARSE else 1.01e-6
            if not _close(x, y, tol):
                bad.setdefault(cols[i], (x, y))
    return bad


def test_feature_values_match_sql(spark, duck):
    from flowrisk.plans import event_features as ef
    c1, r1 = spark_rows(ef.feature_table(spark, SF))
    c2, r2 = duck_rows(duck, ef.feature_table_sql())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert _compare(r1, r2, c1) == {}


def test_bucket_size_does_not_change_results(spark):
    """Small buckets force many halo copies and cross-bucket carries."""
    from flowrisk.plans import event_panel as ep
    from flowrisk.operators.windows import Feat
    feats = [Feat("mx", "trail_max", "fill_ratio", 24), Feat("sm", "trail_sum", "fill_ratio", 100),
             Feat("sd", "trail_std", "fill_ratio", 80), Feat("fw", "fwd_sum", "fill_ratio", 30),
             Feat("tg", "next_max", "fill_ratio", 6), Feat("md", "median", "fill_ratio", 12),
             Feat("hs", "hours_since", "fill_ratio", thr=0.8), Feat("cs", "cumsum", "fill_ratio"),
             Feat("ha", "hours_above", "fill_ratio", 12, thr=0.5)]
    a = ep.fill_panel(spark, SF, feats, bucket_rows=1 << 16)
    b = ep.fill_panel(spark, SF, feats, bucket_rows=150, fit=False)
    ca, ra = spark_rows(a.drop("load"))
    cb, rb = spark_rows(b.drop("load"))
    assert ca == cb and len(ra) == len(rb)
    assert _compare(ra, rb, ca) == {}


def test_long_windows_independent_of_buckets(spark):
    """365-row windows, forward windows and carried state over many small buckets."""
    from flowrisk.plans import supplier_panel as spq
    a = spq.long_window_table(spark, SF)
    b = spq.long_window_table(spark, SF, bucket_rows=400, fit=False)
    ca, ra = spark_rows(a)
    cb, rb = spark_rows(b)
    assert ca == cb and len(ra) == len(rb)
    assert _compare(ra, rb, ca) == {}


def test_windows_match_sliding_frames(spark):
    """Prefix sums and doubling tables against plain sliding frames, short and long."""
    from pyspark.sql import functions as F
    from flowrisk.operators.grid import regular_grid
    from flowrisk.operators.halo import HaloSpec
    from flowrisk.operators.windows import Feat, compute_features, halo_of, sliding_reference
    rows = spark.range(6000).selectExpr("'k' AS k", "timestamp_seconds(1700000000 + id * 60) AS time",
                                        "CAST((id * 7919) % 997 AS DOUBLE) AS v").where("v <> 13")
    how = [(op, n) for op in ("max", "min", "sum", "mean", "std", "var") for n in (3, 64, 65, 2000)]
    feats = [Feat(f"{op}_{n}", f"trail_{op}", "v", n) for op, n in how]
    back, ahead = halo_of(feats)
    lay = regular_grid(rows.withColumn("time", F.col("time").cast("timestamp_ntz")), "k", "time", 60,
                       HaloSpec(700, back, ahead))
    got = compute_features(lay, "k", feats, 1.0, keep=["k", "rn", "v"])
    wide = got.select("*", *[sliding_reference(got, "k", "v", n, op).alias(f"ref_{op}_{n}") for op, n in how])
    for op, n in how:
        a, b = F.col(f"{op}_{n}"), F.col(f"ref_{op}_{n}")
        bad = wide.where(a.isNull() != b.isNull()).count() + wide.where(F.abs(a - b) > 1e-6 * (1 + F.abs(b))).count()
        assert bad == 0, (op, n)
