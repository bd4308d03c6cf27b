"""Successor window, transitions, DFG -- including the hot-case (skew) path."""

import datetime as dt

from pyspark.sql import functions as F

from pathweave.operators import dfg
from pathweave.operators.clean import first_n_cases, ingest_raw, min_case_size
from pathweave.operators.trace import SkewPolicy, transitions, with_successor
from pathweave.sources.eventlog import events_as_log

from conftest import SF, SF_SMALL


def _ts(s):
    return dt.datetime.fromisoformat(s)


def _log(spark, rows):
    return spark.createDataFrame(
        [(c, a, _ts(s), _ts(e), i) for i, (c, a, s, e) in enumerate(rows)],
        "case_id string, activity string, start_ts timestamp, end_ts timestamp, event_id long")


def test_overlap_gives_negative_raw_gap_and_zero_wait(spark):
    log = _log(spark, [("c", "a", "2020-01-06 10:00:00", "2020-01-06 11:00:00"),
                       ("c", "b", "2020-01-06 10:30:00", "2020-01-06 10:45:00"),
                       ("c", "c", "2020-01-06 12:00:00", "2020-01-06 12:10:00")])
    t = {r["activity"]: r for r in transitions(log).collect()}
    assert t["a"]["raw_gap_min"] == -30.0 and t["a"]["waiting_min"] == 0.0
    assert t["b"]["raw_gap_min"] == 75.0 and t["b"]["next_activity"] == "c"
    assert "c" not in t  # last event has no successor


def test_single_event_case_and_ties(spark):
    log = _log(spark, [("solo", "x", "2020-01-06 10:00:00", "2020-01-06 11:00:00"),
                       ("t", "b", "2020-01-06 10:00:00", "2020-01-06 10:05:00"),
                       ("t", "a", "2020-01-06 10:00:00", "2020-01-06 10:05:00")])
    t = transitions(log).collect()
    assert len(t) == 1
    # equal start and end: event_id breaks the tie (b has the smaller id)
    assert (t[0]["activity"], t[0]["next_activity"]) == ("b", "a")
    starts = {r["activity"]: r["n"] for r in dfg.dfg_start_activities(log).collect()}
    assert starts == {"b": 1}  # the one-event case is excluded


def test_holiday_and_weekend_labels(spark):
    log = _log(spark, [
        ("c", "a", "2011-01-17 09:00:00", "2011-01-17 09:10:00"),  # MLK day, Monday
        ("c", "b", "2011-01-15 09:00:00", "2011-01-15 09:10:00"),  # Saturday
        ("c", "z", "2011-01-18 09:00:00", "2011-01-18 09:10:00"),
        ("d", "a", "2011-04-18 09:00:00", "2011-04-18 09:10:00"),  # Patriots' Day (MA)
        ("d", "b", "2011-04-19 09:00:00", "2011-04-19 09:10:00"),
    ])
    t = {(r["case_id"], r["activity"]): r for r in transitions(log, region="MA").collect()}
    assert t[("c", "b")]["day_type"] == "weekend" and t[("c", "b")]["is_weekend"]
    assert t[("c", "a")]["day_type"] == "holiday"
    assert t[("d", "a")]["is_holiday"]
    fed = {(r["case_id"], r["activity"]): r for r in transitions(log, region=None).collect()}
    assert not fed[("d", "a")]["is_holiday"]


def _compare_policies(log):
    cols = ["case_id", "event_id", "next_start", "next_activity"]
    plain = with_successor(log, policy=None).select(*cols)
    split = with_successor(log, policy=SkewPolicy(hot_case_rows=20, segment_rows=7)).select(*cols)
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in split.collect())
    return a, b


def test_hot_case_split_equals_plain_window(spark):
    log = events_as_log(spark, SF_SMALL)
    a, b = _compare_policies(log)
    assert a == b and len(a) == log.count()


def test_hot_case_split_with_one_dominant_case(spark):
    # one case holds a third of all rows, with bursts of equal start times
    log = events_as_log(spark, SF_SMALL)
    hot = log.withColumn("case_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("case_id")))
    hot = hot.withColumn("start_ts", F.when(F.col("event_id") % 7 == 0,
                                            F.date_trunc("hour", "start_ts")).otherwise(F.col("start_ts")))
    a, b = _compare_policies(hot)
    assert a == b


def test_a_case_that_becomes_hot_is_split(spark, tmp_path):
    """The size of cases is looked up in every run, also for a path that was read before."""
    from pathweave.operators import trace as T
    pol = T.SkewPolicy(hot_case_rows=100, segment_rows=50)
    log = events_as_log(spark, SF_SMALL)
    few = log.limit(5)
    path = str(tmp_path / "log")
    few.write.parquet(path)
    assert T._segments(spark.read.parquet(path), "case_id", T.ORDER, pol) is None
    log.withColumn("case_id", F.lit(1).cast("bigint")).write.mode("append").parquet(path)
    again = spark.read.parquet(path)
    assert T._segments(again, "case_id", T.ORDER, pol).select("_seg").distinct().count() >= 10
    cols = ["case_id", "event_id", "next_start", "next_activity"]
    assert sorted(tuple(r) for r in with_successor(again, policy=pol).select(*cols).collect()) == \
        sorted(tuple(r) for r in with_successor(again, policy=None).select(*cols).collect())


def test_dfg_counts_match_transitions(spark):
    log = events_as_log(spark, SF)
    edges = dfg.dfg_edges(log)
    assert edges.agg(F.sum("n")).first()[0] == transitions(log).count() == 9850
    assert edges.count() == 25


def test_performance_is_start_to_start(spark):
    log = _log(spark, [("c", "a", "2020-01-06 10:00:00", "2020-01-06 11:00:00"),
                       ("c", "b", "2020-01-06 10:30:00", "2020-01-06 10:45:00")])
    r = dfg.dfg_performance(log).first()
    assert r["mean_seconds"] == 1800.0 and r["label"] == "30.00 min"


def test_plan_has_one_exchange_for_the_trace(spark):
    log = events_as_log(spark, SF)
    plan = transitions(log, policy=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ingest_raw_fill_and_drop(spark):
    raw = spark.createDataFrame([("e1", "2020-01-01 00:00:00", "2020-01-01 01:00:00", None),
                                 ("e1", "junk", "2020-01-01 01:00:00", "x"),
                                 (None, "2020-01-01 00:00:00", "2020-01-01 01:00:00", "y")],
                                "ENCOUNTER string, START string, STOP string, DESCRIPTION string")
    out = ingest_raw(raw).collect()
    assert len(out) == 1 and out[0]["activity"] == "UNKNOWN_ACTIVITY"


def test_cohort_and_min_case_size(spark):
    log = _log(spark, [("late", "a", "2020-01-03 00:00:00", "2020-01-03 00:10:00"),
                       ("early", "a", "2020-01-01 00:00:00", "2020-01-01 00:10:00"),
                       ("early", "b", "2020-01-04 00:00:00", "2020-01-04 00:10:00"),
                       ("mid", "a", "2020-01-02 00:00:00", "2020-01-02 00:10:00")])
    assert {r["case_id"] for r in first_n_cases(log, 2).collect()} == {"early", "mid"}
    assert first_n_cases(log, 2).count() == 3
    assert {r["case_id"] for r in min_case_size(log, 2).collect()} == {"early"}


def test_min_case_size_drops_the_null_case(spark):
    import pathweave.operators.clean as C
    log = _log(spark, [("a", "x", "2020-01-01 00:00:00", "2020-01-01 00:10:00"),
                       ("a", "y", "2020-01-01 01:00:00", "2020-01-01 01:10:00"),
                       ("b", "x", "2020-01-01 00:00:00", "2020-01-01 00:10:00")])
    log = log.union(spark.createDataFrame([(None, "z", _ts("2020-01-01 00:00:00"), _ts("2020-01-01 00:01:00"), 99)],
                                          log.schema))
    assert sorted(r["event_id"] for r in C.min_case_size(log, 2).collect()) == [0, 1]


def test_cohort_ties_break_by_event_id(spark):
    rows = [("p", "a", _ts("2020-01-01 00:00:00"), _ts("2020-01-01 00:10:00"), 5),
            ("q", "a", _ts("2020-01-01 00:00:00"), _ts("2020-01-01 00:10:00"), -3),
            ("r", "a", _ts("2019-12-31 23:59:59.999999"), _ts("2020-01-01 00:10:00"), 10**18)]
    log = spark.createDataFrame(rows, "case_id string, activity string, start_ts timestamp, end_ts timestamp, event_id long")
    assert {r["case_id"] for r in first_n_cases(log, 1).collect()} == {"r"}
    assert {r["case_id"] for r in first_n_cases(log, 2).collect()} == {"r", "q"}


def test_hot_case_with_one_timestamp_is_split(spark):
    from pathweave.operators import trace as T
    log = events_as_log(spark, SF)
    # a third of all rows in one case, all at the same start and end
    tied = (log.withColumn("case_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("case_id")))
            .withColumn("start_ts", F.when(F.col("case_id") == -1, F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
                        .otherwise(F.col("start_ts")))
            .withColumn("end_ts", F.when(F.col("case_id") == -1, F.lit("2024-01-10 12:05:00").cast("timestamp_ntz"))
                        .otherwise(F.col("end_ts"))))
    pol = T.SkewPolicy(hot_case_rows=1000, segment_rows=300)
    segs = T._segments(tied, "case_id", T.ORDER, pol).filter("case_id = -1").groupBy("_seg").count().collect()
    assert len(segs) >= 8 and max(r["count"] for r in segs) < 3 * 300   # the tie group is cut into balanced pieces
    cols = ["case_id", "event_id", "next_start", "next_activity"]
    plain = sorted(tuple(r) for r in T.with_successor(tied, policy=None).select(*cols).collect())
    split = sorted(tuple(r) for r in T.with_successor(tied, policy=pol).select(*cols).collect())
    assert plain == split


def test_encoded_activities_same_result(spark):
    log = events_as_log(spark, SF_SMALL)
    log = log.withColumn("activity", F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("activity")))
    cols = ["case_id", "activity", "event_id", "next_start", "next_activity"]
    for pol in (None, SkewPolicy(hot_case_rows=20, segment_rows=7)):
        a = sorted((tuple(r) for r in with_successor(log, policy=pol).select(*cols).collect()), key=repr)
        b = sorted((tuple(r) for r in with_successor(log, policy=pol, encode_activities=True)
                    .select(*cols).collect()), key=repr)
        assert a == b and len(a) == log.count()
    t1 = sorted((tuple(r) for r in transitions(log).collect()), key=repr)
    t2 = sorted((tuple(r) for r in transitions(log, encode_activities=True).collect()), key=repr)
    assert t1 == t2


def test_holiday_on_a_weekend_is_a_holiday(spark):
    # 2011-01-01 is a Saturday and New Year's Day: holiday wins over weekend
    log = _log(spark, [("c", "a", "2011-01-01 09:00:00", "2011-01-01 09:10:00"),
                       ("c", "b", "2011-01-01 10:00:00", "2011-01-01 10:10:00")])
    r = transitions(log).first()
    assert r["is_weekend"] and r["is_holiday"] and r["day_type"] == "holiday"
