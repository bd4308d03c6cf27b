"""Feature-table operators, after the reference's unit cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pathweave.operators import features
from pathweave.plans.featurize import FEATURES_NAME, build_features
from pathweave.sources.eventlog import read_log, to_reference_names, write_features


def _ts(s):
    return dt.datetime.fromisoformat(s)


def test_load_missing_file_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_log(spark, str(tmp_path / "nope.csv"), fmt="csv")


def test_load_parses_timestamps(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("case:concept:name,concept:name,start:timestamp,end:timestamp\n"
                 "enc_1,proc_a,2020-01-01T00:00:00Z,2020-01-01T01:00:00Z\n"
                 "enc_1,proc_b,2020-01-01T01:15:00Z,2020-01-01T01:45:00Z\n")
    log = read_log(spark, str(p), fmt="csv")
    assert log.count() == 2
    types = dict(log.dtypes)
    assert types["start_ts"] == "timestamp" and types["end_ts"] == "timestamp"
    r = log.orderBy("start_ts").first()
    assert r["start_ts"] == _ts("2020-01-01 00:00:00")


def test_load_drops_bad_timestamps(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("case:concept:name,concept:name,start:timestamp,end:timestamp\n"
                 "enc_1,proc_a,2020-01-01T00:00:00Z,not a time\n"
                 "enc_1,proc_b,2020-02-30T01:15:00Z,2020-01-01T01:45:00Z\n"
                 "enc_1,proc_c,2020-01-01T02:00:00Z,2020-01-01T03:00:00Z\n")
    assert read_log(spark, str(p), fmt="csv").count() == 1


def _log(spark, rows):
    return spark.createDataFrame(
        [(c, a, _ts(s), _ts(e), i) for i, (c, a, s, e) in enumerate(rows)],
        "case_id string, activity string, start_ts timestamp, end_ts timestamp, event_id long")


def test_summary_duration_positive(spark):
    log = _log(spark, [("enc_a", "proc_a", "2020-01-01 00:00:00", "2020-01-01 01:00:00"),
                       ("enc_a", "proc_b", "2020-01-01 01:10:00", "2020-01-01 02:00:00")])
    r = features.case_summary(log).first()
    assert r["event_count"] == 2
    assert r["encounter_duration_minutes"] == 120
    assert r["total_hours"] == 2


def test_summary_drops_non_positive(spark):
    log = _log(spark, [("enc_z", "a", "2020-01-01 00:00:00", "2020-01-01 00:00:00")])
    assert features.case_summary(log).count() == 0


def test_proc_matrix_counts_topk(spark):
    log = spark.createDataFrame([("enc_a", "proc_a"), ("enc_a", "proc_a"), ("enc_a", "proc_b"),
                                 ("enc_b", "proc_b")], "case_id string, activity string")
    m = {r["case_id"]: r for r in features.proc_matrix(log, k=2).collect()}
    assert "proc_count__proc_a" in features.proc_matrix(log, k=2).columns
    assert m["enc_a"]["proc_count__proc_a"] == 2
    assert m["enc_b"]["proc_count__proc_a"] == 0


def test_proc_matrix_trims_and_orders_columns(spark):
    log = spark.createDataFrame([("c", " zeta "), ("c", "alpha"), ("c", "zeta")], "case_id string, activity string")
    cols = features.proc_matrix(log, k=5).columns
    assert cols == ["case_id", "proc_count__alpha", "proc_count__zeta"]
    assert features.proc_matrix(log, k=5).first()["proc_count__zeta"] == 2


def test_case_features_fill_zero(spark):
    log = _log(spark, [("enc_x", "proc_a", "2020-02-01 00:00:00", "2020-02-01 01:00:00"),
                       ("enc_x", "proc_b", "2020-02-01 01:15:00", "2020-02-01 02:15:00"),
                       ("enc_y", "proc_b", "2020-02-02 03:00:00", "2020-02-02 04:00:00")])
    f = {r["case_id"]: r for r in features.case_features(log, k=50).collect()}
    assert f["enc_y"]["proc_count__proc_a"] == 0
    assert f["enc_x"]["encounter_duration_minutes"] == 135


def test_save_features_and_end_to_end(spark, tmp_path):
    p = tmp_path / "processed.csv"
    p.write_text("case:concept:name,concept:name,start:timestamp,end:timestamp\n"
                 "enc_x,proc_a,2020-02-01T00:00:00Z,2020-02-01T01:00:00Z\n"
                 "enc_x,proc_b,2020-02-01T01:15:00Z,2020-02-01T02:15:00Z\n"
                 "enc_y,proc_b,2020-02-02T03:00:00Z,2020-02-02T04:00:00Z\n")
    out = build_features(spark, str(p), str(tmp_path / "features"))
    assert out.endswith(FEATURES_NAME)
    df = spark.read.parquet(out)
    assert {"encounter_duration_minutes", "total_hours", "event_count"} <= set(df.columns)
    assert any(c.startswith("proc_count__") for c in df.columns)
    assert df.count() == 2


def test_write_features_returns_path(spark, tmp_path):
    df = spark.createDataFrame([("enc_a", 60.0, 1.0), ("enc_b", 30.0, 0.5)],
                               "case_id string, encounter_duration_minutes double, total_hours double")
    path = write_features(df, str(tmp_path / FEATURES_NAME))
    assert path.endswith(FEATURES_NAME)
    assert spark.read.parquet(path).count() == 2


def test_reference_names_roundtrip(spark):
    log = _log(spark, [("c", "a", "2020-01-01 00:00:00", "2020-01-01 00:01:00")])
    assert "case:concept:name" in to_reference_names(log).columns


def test_topk_rows(spark):
    log = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b"), ("d", "c")], "case_id string, activity string")
    assert sorted(r["activity"] for r in features.topk_rows(log, 1).collect()) == ["a", "a"]
    # ties broken by name
    assert [r["activity"] for r in features.top_activities(log, 2).collect()] == ["a", "b"]


def test_strict_log_scan_raises(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("case:concept:name,concept:name,start:timestamp,end:timestamp\n"
                 "enc_1,proc_a,2020-01-01T00:00:00Z,not a time\n")
    with pytest.raises(Exception):
        read_log(spark, str(p), fmt="csv", strict=True).collect()
