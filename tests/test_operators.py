"""Small hand cases from FIXTURES.md (sections 3 and 4) for individual operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF

T0 = dt.datetime(2024, 1, 1)


def _ts(i, minutes=2):
    return T0 + dt.timedelta(minutes=minutes * i)


def test_drop_duplicated_times(spark):
    from flowrisk.operators.grid import drop_duplicated_times
    df = spark.createDataFrame([("a", _ts(0), 1), ("a", _ts(1), 2), ("a", _ts(1), 3), ("a", _ts(2), 4)],
                               "k string, t timestamp, v int")
    got = sorted(r.v for r in drop_duplicated_times(df, "k", "t").collect())
    assert got == [1, 4]


def _panel(spark, values, feats, step_h=2 / 60):
    from flowrisk.operators.grid import regular_grid
    from flowrisk.operators.halo import HaloSpec
    from flowrisk.operators.windows import compute_features, halo_of
    rows = [("a", _ts(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, t timestamp, x double")
    lb, la = halo_of(feats)
    lay = regular_grid(df, "k", "t", 120, HaloSpec(2, lb, la))
    out = compute_features(lay, "k", feats, step_h)
    return [r.asDict() for r in out.orderBy("rn").collect()]


@pytest.mark.parametrize("bucket", [2, 1000])
def test_full_window_rule_and_target(spark, bucket):
    from flowrisk.operators.windows import Feat
    r = _panel(spark, [1.0, None, 3.0, 4.0, 5.0], [Feat("mx", "trail_max", "x", 3)])
    assert [x["mx"] for x in r] == [None, None, None, None, 5.0]
    r = _panel(spark, [1.0, 5.0, 2.0, 3.0], [Feat("tg", "next_max", "x", 2)])
    assert [x["tg"] for x in r] == [5.0, 3.0, None, None]


def test_time_since_true(spark):
    from flowrisk.operators.windows import Feat
    r = _panel(spark, [0.1, 0.9, 0.1, 0.1], [Feat("ts", "hours_since", "x", thr=0.5)])
    got = [x["ts"] for x in r]
    assert got[0] is None and got[1] == 0
    assert abs(got[2] - 2 / 60) < 1e-12 and abs(got[3] - 4 / 60) < 1e-12


def test_gap_limit_linear(spark):
    from flowrisk.operators.gapfill import fill_gaps
    from flowrisk.operators.grid import core_rows, regular_grid
    from flowrisk.operators.halo import HaloSpec
    rows = [("a", _ts(i), v) for i, v in enumerate([0.0, None, None, None, 4.0, None, 1.0])]
    df = spark.createDataFrame(rows, "k string, t timestamp, x double")
    halo = HaloSpec(3, 1, 1)
    lay = regular_grid(df, "k", "t", 120, halo)
    out = core_rows(fill_gaps(lay, "k", ["x"], 2, halo)).orderBy("rn").collect()
    # limit 2: the first two rows of the 3-row gap are filled; the gap after 4.0 too
    assert [r.x for r in out] == [0.0, 1.0, 2.0, None, 4.0, 2.5, 1.0]


def test_folds_n10_k3(spark):
    from flowrisk.operators.cv import fold_roles
    df = spark.createDataFrame([(i, 10) for i in range(10)], "row_idx long, n_train long")
    r = fold_roles(df, 3).collect()
    val = {f: sorted(x.row_idx for x in r if x.fold == f and x.role == "val") for f in (1, 2, 3)}
    tr = {f: sorted(x.row_idx for x in r if x.fold == f and x.role == "train") for f in (1, 2, 3)}
    assert val == {1: [4, 5], 2: [6, 7], 3: [8, 9]}
    assert tr == {1: [0, 1, 2, 3], 2: list(range(6)), 3: list(range(8))}


def test_conformal_n9(spark):
    from flowrisk.operators.conformal import conformal_threshold
    # nonconformity 0.1..0.9: negatives with p = score
    rows = [("g", 0, s / 10) for s in range(1, 9)] + [("g", 1, 0.1)]  # 1 - 0.1 = 0.9
    df = spark.createDataFrame(rows, "g string, y int, p double")
    r = conformal_threshold(df, "g", 0.1).collect()[0]
    assert r.q_level == 1.0 and abs(r.q_hat - 0.9) < 1e-12 and abs(r.conf_threshold - 0.1) < 1e-12


def test_one_class_metrics(spark):
    from flowrisk.operators.metrics import binary_metrics
    neg = spark.createDataFrame([("g", 0, 0.2, 0), ("g", 0, 0.7, 1)], "grp string, y int, p double, pred int")
    r = binary_metrics(neg, "grp").collect()[0]
    assert r.ROC_AUC is None and r.PR_AUC == 0.0 and r.Precision == 0 and r.Recall == 0 and r.F1 == 0
    pos = spark.createDataFrame([("g", 1, 0.2, 0), ("g", 1, 0.7, 1)], "grp string, y int, p double, pred int")
    r = binary_metrics(pos, "grp").collect()[0]
    assert r.ROC_AUC is None and r.PR_AUC == 1.0 and r.Specificity is None


def test_auc_ties_and_ap(spark):
    from flowrisk.operators.metrics import rank_metrics
    rows = [("g", 1, 0.8), ("g", 0, 0.8), ("g", 1, 0.4), ("g", 0, 0.1), ("g", 0, 0.5)]
    r = rank_metrics(spark.createDataFrame(rows, "grp string, y int, p double"), "grp", "y", "p").collect()[0]
    # pairs: (0.8 vs 0.8)=0.5, (0.8>0.1), (0.8>0.5), (0.4>0.1), 0.4<0.8, 0.4<0.5 -> 3.5/6
    assert abs(r.ROC_AUC - 3.5 / 6) < 1e-12
    # AP: thresholds 0.8 (R=.5, P=.5), 0.4 (R=1, P=2/4) -> .5*.5 + .5*.5
    assert abs(r.PR_AUC - 0.5) < 1e-12


def test_ranks_with_tie(spark):
    from flowrisk.operators.evaluate import metric_ranks
    rows = [("s", 1, "exceedance_metrics", "MAE", m, v) for m, v in
            [("Persistence", 0.3), ("EnsembleClassifier", 0.2), ("ConformalEnsemble", 0.2)]]
    df = spark.createDataFrame(rows, "station_id string, horizon_hours int, section string, "
                                     "metric string, model string, value double")
    got = {r.model: r.rank for r in metric_ranks(df).collect()}
    assert got == {"Persistence": 3.0, "EnsembleClassifier": 1.5, "ConformalEnsemble": 1.5}


REPORT = ("**IDENTIFIER: 1,FM02\n*CSTART\n2401010000 2401010008   2\n*CEND\n"
          "   12  130 0.45   13  131 0.46\nxxxxxxxxxxxxxxx   14  132 0.47\n")


def test_report_parse(spark):
    from flowrisk.sources.reports import parse_flow
    docs = spark.createDataFrame([("1", "a.fdv", REPORT), ("1", "b.fdv", "no markers\n 1 2 0.1")],
                                 "report_id string, source_file string, text string")
    rec, rej = parse_flow(docs)
    rows = rec.orderBy("record_idx").collect()
    assert [r.station_id for r in rows] == ["FM02"] * 3
    assert [r.time for r in rows] == [dt.datetime(2024, 1, 1, 0, m) for m in (0, 2, 4)]
    assert [(r.flow_l_s, r.depth_mm, r.velocity_m_s) for r in rows] == \
        [(12, 130, 0.45), (13, 131, 0.46), (14, 132, 0.47)]
    assert [r.source_file for r in rej.collect()] == ["b.fdv"]


def test_int_spec_and_two_digit_years(spark):
    from flowrisk.functions.text import expand_int_spec, parse_stamp
    df = spark.createDataFrame([("1,3-5 & 7",), ("5-3",)], "s string")
    got = [r.v for r in df.select(expand_int_spec(F.col("s")).alias("v")).collect()]
    assert got == [[1, 3, 4, 5, 7], None]
    d = spark.createDataFrame([("9901010000",), ("2401010000",)], "s string")
    got = [r.t for r in d.select(parse_stamp(F.col("s"), 10).alias("t")).collect()]
    assert got == [dt.datetime(1999, 1, 1), dt.datetime(2024, 1, 1)]


def test_decode_cascade(spark):
    from flowrisk.sources.reports import decode_text
    data = [(b"\xef\xbb\xbfhello",), ("café".encode("cp1252"),), (b"a\x81b",)]
    df = spark.createDataFrame(data, "c binary")
    got = [r.t for r in df.select(decode_text("c").alias("t")).collect()]
    assert got == ["hello", "café", "a\x81b"]


def test_partitioned_sink_roundtrip(spark, tmp_path):
    """Partitioned write, dynamic overwrite of one partition, pruned read."""
    from flowrisk.sources.reports import write_tables
    p = str(tmp_path / "pred")
    df = spark.createDataFrame([("a", 1, 0.1), ("b", 6, 0.2)], "station_id string, h int, p double")
    write_tables(df, p, ["station_id"])
    write_tables(spark.createDataFrame([("a", 1, 0.9)], "station_id string, h int, p double"), p,
                 ["station_id"])
    got = sorted((r.station_id, r.p) for r in spark.read.parquet(p).collect())
    assert got == [("a", 0.9), ("b", 0.2)]
    plan = spark.read.parquet(p).where("station_id = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "station_id" in plan


def test_pending_runs_and_latest(spark):
    from flowrisk.operators.grid import latest_rows
    from flowrisk.plans.training import pending_runs
    st = spark.createDataFrame([("a",), ("b",)], "station_id string")
    done = spark.createDataFrame([("a", 1)], "station_id string, horizon_hours int")
    got = sorted(tuple(r) for r in pending_runs(st, [1, 6], done).collect())
    assert got == [("a", 6), ("b", 1), ("b", 6)]
    df = spark.createDataFrame([("a", _ts(0), 1.0), ("a", _ts(3), 2.0), ("b", _ts(1), 3.0)],
                               "k string, t timestamp, v double")
    assert sorted((r.k, r.v) for r in latest_rows(df, "k", "t").collect()) == [("a", 2.0), ("b", 3.0)]


def test_typed_readers(spark, tmp_path):
    from flowrisk.sources.readers import read_monitors, read_readings
    p = tmp_path / "m.csv"
    p.write_text("type,id,alt_id,site_name,pipe_diameter_mm,recently_active,lat,lon\n"
                 "flow_monitor,9576,31144.0,FMT15 - WESTGATE,600.0,yes,50.8,-0.7\n")
    m = read_monitors(spark, str(p)).collect()[0]
    assert m.pipe_diameter_mm == 600.0 and m.alt_id == "31144.0"
    r = tmp_path / "r.csv"
    r.write_text("dateTime,value,valueQualifier\n2024-01-01T00:00:00,0.2,Good\n2024-01-01T00:15:00,NaN,\n")
    rows = read_readings(spark, str(r), "rain_hde").collect()
    assert rows[0].rain_hde == 0.2 and rows[1].rain_hde is None and rows[0].__fields__ == ["time", "rain_hde"]


def test_report_folders_zip_and_dedup(spark, tmp_path):
    """S6-S9 + C3: folder discovery, zip members, bad zip, replication to report ids."""
    import zipfile

    from flowrisk.sources.reports import (discover_files, docs_for_parsing, parse_flow,
                                          replicate_and_dedup, report_texts)
    raw = tmp_path / "raw"
    (raw / "Chichester weekly report - interim 1,3-4").mkdir(parents=True)
    (raw / "Chichester weekly report - interim 1,3-4" / "A.FDV").write_text(REPORT)
    (raw / "p2-3" / "p3").mkdir(parents=True)
    with zipfile.ZipFile(raw / "p2-3" / "p3" / "bundle.zip", "w") as z:
        z.writestr("inner/B.fdv", REPORT)
        z.writestr("notes.txt", "ignore")
    (raw / "p2-3" / "p3" / "broken.zip").write_bytes(b"not a zip")
    (raw / "other").mkdir()
    (raw / "other" / "C.fdv").write_text(REPORT)
    files = discover_files(spark, str(raw))
    assert sorted(r.folder for r in files.collect()) == [
        "Chichester weekly report - interim 1,3-4", "p3", "p3"]
    texts = report_texts(files)
    t = {r.source_file: r for r in texts.collect()}
    assert set(t) == {"A.FDV", "bundle.zip::inner/B.fdv", "broken.zip"}
    assert t["broken.zip"].reject_reason.startswith("bad zip")
    rec, rej = parse_flow(docs_for_parsing(texts))
    assert rec.count() == 6 and rej.count() == 0
    ded = replicate_and_dedup(rec, ["station_id", "start_time", "end_time", "interval_min",
                                    "time", "record_idx", "flow_l_s", "depth_mm", "velocity_m_s"])
    got = ded.collect()
    assert len(got) == 3 and {r.source_file for r in got} == {"A.FDV"}


def test_components_of_a_long_chain(spark):
    from flowrisk.operators.select import connected_components
    n = 70
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n + 1)], "feature string")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(1, n)], "a string, b string")
    got = {r["feature"]: r["group"] for r in connected_components(spark, nodes, edges).collect()}
    assert got.pop("n000") == "n000" and set(got.values()) == {"n001"} and len(got) == n


@pytest.mark.parametrize("axis,x,expected", [
    ([0.0, 2.5, 5.0], 7.4, 5.0), ([-1.01, 1.99], 0.05, -1.01), ([-1.01, 1.99], -50.0, -1.01),
    ([0.0, 100.0], 50.0, 0.0), ([0.0, 100.0], 50.1, 100.0), ([3.0], 3.0, 3.0)])
def test_nearest_axis_of_any_spacing(spark, axis, x, expected):
    from flowrisk.operators.gridpoint import nearest_axis
    points = spark.createDataFrame([(1, x)], "point int, lat double")
    axes = spark.createDataFrame([(v,) for v in axis], "value double")
    assert [tuple(r) for r in nearest_axis(points, axes, "lat", "latitude").collect()] == [(1, expected)]


def test_scores_near_zero_spread_over_bins(spark):
    """99 of 100 scores within one thousandth: no bin of distinct scores is much larger."""
    from flowrisk.operators.metrics import balanced_bins
    df = spark.range(20_000).selectExpr("'g' AS grp", "CASE WHEN id % 100 = 0 THEN id / 20000.0 ELSE id / 2e7 END AS s")
    sizes = [r["n"] for r in balanced_bins(df.distinct(), "grp", "s").groupBy("_bin").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 100 and max(sizes) < 3 * 20_000 / 128


def test_count_at_least_with_ties(spark):
    from flowrisk.operators.risk import count_at_least
    q = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.0, 0.5, 0.5, 1.0, None])], "g string, i int, x double")
    s = spark.createDataFrame([("g", v) for v in [0.0, 0.5, 0.5, 0.5, 0.9, 1.0, 1.0]], "g string, v double")
    got = {r["i"]: r["n"] for r in count_at_least(q, s, "g", "x", "v", "n").collect()}
    assert got == {0: 7, 1: 6, 2: 6, 3: 2, 4: 0}


def test_fold_counts_match_fold_rows(spark):
    from flowrisk.operators import cv
    df = spark.range(53).selectExpr("'a' AS k", "id AS row_idx", "47L AS n_train", "CAST(id % 5 = 0 AS INT) AS y")
    got = {(r["fold"]): (r["n_train_rows"], r["n_pos"], r["n_val"]) for r in cv.fold_counts(df, "k", 5).collect()}
    for fold in range(1, 6):
        train, val = (cv.fold_part(df, 5, fold, role) for role in ("train", "val"))
        assert got[fold] == (train.count(), train.where("y = 1").count(), val.count())


def test_unreadable_folders_become_rejects(spark):
    from flowrisk.sources import reports as rp
    rows = [("chichester weekly report - interim 9-3", "a.fdv", ".fdv", bytearray(b"text")),
            ("p4", "b.fdv", ".fdv", bytearray(b"no markers")), ("p4", "c.zip", ".zip", bytearray(b"broken"))]
    files = spark.createDataFrame(rows, "folder string, source_file string, kind string, content binary")
    texts = rp.report_texts(files.withColumn("report_ids", rp.folder_report_ids(F.col("folder"))))
    _, bad = rp.parse_flow(rp.docs_for_parsing(texts))
    reasons = {r["source_file"]: r["reason"] for r in rp.rejected(texts, bad).collect()}
    assert set(reasons) == {"a.fdv", "b.fdv", "c.zip"} and reasons["c.zip"].startswith("bad zip")


def test_training_fits_every_station(spark):
    """Every station of the panel has a usable fold, so that models are fitted and scored."""
    from flowrisk.plans.training import training_folds
    rows = training_folds(spark, SF).where("usable").select("event_type").distinct().collect()
    assert len(rows) == 5


def test_windows_1252_of_every_byte(spark):
    from flowrisk.sources.reports import decode_text
    defined = bytes(b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    rows = [(defined,), (bytes(range(0x80, 0x100)),), ("﻿dépth".encode(),), ("é".encode(),), (b"",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "content binary").select(decode_text("content")).collect()]
    assert got == [defined.decode("cp1252"), bytes(range(0x80, 0x100)).decode("latin-1"), "dépth", "é", "", None]


def test_merge_joins_the_touched_partitions(spark, tmp_path):
    """Batches merge by key and day, null keys and times too; the plan does not grow with the batch."""
    from flowrisk.streaming import upsert
    kind = "k string, ts timestamp, v double"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    target = f"{tmp_path}/t"
    first = [("a", at(1, 0), 1.0), ("a", at(2, 0), 1.0), ("b", at(1, 0), 1.0), (None, at(1, 0), 1.0), ("b", None, 1.0)]
    second = [("a", at(2, 0), 2.0), ("a", at(2, 5), 2.0), (None, at(1, 0), 2.0), ("b", None, 2.0), ("c", at(9, 0), 2.0)]
    for i, rows in enumerate((first, second)):
        upsert.merge_batch(spark.createDataFrame(rows, kind), i, target, ["k"], "ts")
    got = {(r["k"], r["ts"]): r["v"] for r in spark.read.parquet(target).collect()}
    assert got == {(k, t): v for k, t, v in first + second}

    old = spark.read.parquet(target)
    plans = []
    for n in (2, 300):
        listed = upsert.stage(spark.range(n).selectExpr("concat('k', id) k", "date'2024-01-01' + cast(id as int) day"))
        plans.append(upsert.partitions_listed(old, listed, ["k", "day"])._jdf.queryExecution().executedPlan().toString())
    assert "dynamicpruning" in plans[0].lower()
    assert plans[0].count("\n") == plans[1].count("\n")
