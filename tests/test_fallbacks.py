"""Joins without broadcast: same results when the planner may not broadcast a side."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pathweave.functions import calendar as C
from pathweave.operators import clean, features, stats
from pathweave.operators import trace as T
from pathweave.sources.eventlog import events_as_log

from conftest import SF_SMALL


@pytest.fixture(params=["-1", "10485760"])
def threshold(spark, request):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_split_trace(spark, threshold):
    log = events_as_log(spark, SF_SMALL)
    cols = ["case_id", "event_id", "next_start", "next_activity"]
    plain = _rows(T.with_successor(log, policy=None), cols)
    assert _rows(T.with_successor(log, policy=T.SkewPolicy(hot_case_rows=20, segment_rows=7)), cols) == plain


def test_prefix_sums(spark, threshold):
    c = stats.value_counts(stats.wait_groups_long(T.transitions(events_as_log(spark, SF_SMALL))))
    cum = stats.cumulative_counts(c, ("dimension", "grp")).toPandas()
    for _, g in cum.groupby(["dimension", "grp"]):
        g = g.sort_values("value")
        assert list(g["n_le"]) == list(g["cnt"].cumsum()) and (g["n"] == g["cnt"].sum()).all()


def test_holiday_table(spark, threshold):
    df = spark.createDataFrame([(dt.date(2024, 3, d),) for d in (1, 2, 3)], "d date")
    hol = spark.createDataFrame([(dt.date(2024, 3, 2),), (dt.date(2024, 3, 2),)], "date date")
    got = {str(r["d"]): r["is_holiday"] for r in C.with_holiday_table(df, "d", hol).collect()}
    assert got == {"2024-03-01": False, "2024-03-02": True, "2024-03-03": False}


def test_semi_and_anti_joins(spark, threshold):
    log = events_as_log(spark, SF_SMALL)
    sizes = {r["case_id"]: r["count"] for r in log.groupBy("case_id").count().collect()}
    k = sorted(sizes.values())[len(sizes) // 2]
    kept = clean.min_case_size(log, k).groupBy("case_id").count().collect()
    assert {r["case_id"]: r["count"] for r in kept} == {c: n for c, n in sizes.items() if n >= k} != sizes
    assert clean.first_n_cases(log, 3).select("case_id").distinct().count() == 3
    top = {r["activity"] for r in features.top_activities(log, 2).collect()}
    assert {r["activity"] for r in features.topk_rows(log, 2).select("activity").distinct().collect()} == top
    assert log.filter(F.col("activity").isin(list(top))).count() == features.topk_rows(log, 2).count()
