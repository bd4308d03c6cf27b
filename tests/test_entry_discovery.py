"""Driver entry points and the end-to-end discovery plan."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from pathweave.plans.discovery import discover
from pathweave.sources.eventlog import events_as_log

from conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["case_id", "activity", "next_activity"]
    assert df.count() > 0


def test_every_log_query_has_an_oracle_but_raw_predictions():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {n for n in set(q) - set(o) if n.startswith("q_")} == {"q_gbt_score", "q_feature_model"}


def test_discovery_drops_small_cases_first(spark):
    import datetime as dt

    at = dt.datetime(2024, 5, 6, 8)
    rows = [(case, act, at + dt.timedelta(minutes=10 * i), at + dt.timedelta(minutes=10 * i + 5), n)
            for n, (case, act, i) in enumerate([("p", "x", 0), ("p", "y", 1), ("q", "x", 0), ("q", "y", 1), ("q", "z", 2)])]
    log = spark.createDataFrame(rows, "case_id string, activity string, start_ts timestamp, end_ts timestamp, event_id long")
    d = discover(log, rules=None, min_events=3)
    assert {(r["src"], r["dst"], r["n"]) for r in d.edges.collect()} == {("x", "y", 1), ("y", "z", 1)}
    assert [(r["activity"], r["n"]) for r in d.starts.collect()] == [("x", 1)]


def test_uneven_queries_would_notice_a_missing_operator(spark):
    """Each derived fixture holds what its operator must change."""
    sf = "/root/testdata/sf0.01"
    log = events_as_log(spark, sf)
    cases = log.select("case_id").distinct().count()
    assert 0 < E.q_case_sizes(spark, sf).count() < cases
    assert 0 < E.q_case_summary_uneven(spark, sf).count() < E.q_training_rows_uneven(spark, sf).count() < log.count()
    cells = E.q_proc_matrix_top3(spark, sf)
    assert cells.filter("n = 0").count() and cells.filter("n > 1").count() and E.q_multi_hot_top3(spark, sf).agg(F.max("n")).first()[0] == 1
    assert E.q_case_features_top3(spark, sf).count() > cells.count()
    assert E.q_daily_mean_filtered(spark, sf).filter("avg_wait_min IS NULL").count() == 2
    assert {r["above_limit"] for r in E.q_hourly_mean_limit(spark, sf).collect()} == {True, False}
    assert E.q_slot_forecast_filtered(spark, sf).filter("slot_n = 0 AND predicted_min = 30.0").count() > 100
    assert E.q_collapse_clinical(spark, sf).select("activity").distinct().count() == 9
    assert E.q_calendar_hours(spark, sf).select("time_of_day").distinct().count() == 2
    names = [c for c in E.q_case_features_labels(spark, sf).columns if c.startswith("proc_count__")]
    assert len({n.lower() for n in names}) == 15 and not any("." in n for n in names)


def test_discover_materialized_matches_lazy(spark):
    log = events_as_log(spark, SF_SMALL)
    lazy = discover(log)
    mat = discover(log, materialize=True)
    for name in ("edges", "starts", "ends", "performance", "wait_summary", "box_stats"):
        a = sorted(tuple(r) for r in getattr(lazy, name).collect())
        b = sorted(tuple(r) for r in getattr(mat, name).collect())
        assert a == b, name
    assert lazy.edges.agg(F.sum("n")).first()[0] == lazy.transitions.count()
    assert lazy.ecdf.count() == mat.ecdf.count()
