"""The log in buckets by case: rows, plans without exchange, hot cases, edge cases."""

import pytest
from pyspark.sql import functions as F

from pathweave.operators import dfg, features
from pathweave.operators.trace import CaseSizes, SkewPolicy, case_endpoints, transitions, with_successor
from pathweave.sources import events_as_log
from pathweave.sources.bucketed import read_bucketed_log, write_bucketed_log

from conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def bucketed(spark, tmp_path):
    return read_bucketed_log(spark, write_bucketed_log(events_as_log(spark, SF_SMALL), str(tmp_path / "it's a log"), n_buckets=5))


def test_rows_and_sizes_come_back(spark, bucketed):
    log = events_as_log(spark, SF_SMALL)
    assert bucketed.log.dtypes == log.dtypes and rows(bucketed.log) == rows(log)
    top = log.groupBy("case_id").count().agg(F.max("count")).first()[0]
    assert bucketed.sizes == CaseSizes(top, log.count()) and bucketed.n_buckets == 5
    of_file = bucketed.log.groupBy(F.input_file_name()).agg(F.countDistinct(F.pmod(F.hash("case_id"), F.lit(5))).alias("n"))
    assert {r.n for r in of_file.collect()} == {1}


def test_plans_by_case_have_no_exchange(spark, bucketed):
    log = events_as_log(spark, SF_SMALL)
    names = features.top_activity_list(log, 5)
    for build in (lambda x, **s: transitions(x, **s), lambda x, **s: with_successor(x, **s), lambda x, **_: case_endpoints(x),
                  lambda x, **_: features.case_features(x, names=names)):
        mine = build(bucketed.log, sizes=bucketed.sizes)
        assert "Exchange" not in plan(mine) and "Exchange" in plan(build(log))
        assert rows(mine) == rows(build(log))
    assert rows(dfg.dfg_edges(bucketed.log)) == rows(dfg.dfg_edges(log))


def test_known_sizes_spare_the_count(spark, bucketed, monkeypatch):
    from pathweave.operators import trace

    counted = []
    monkeypatch.setattr(trace, "CaseSizes", lambda *a: counted.append(a) or CaseSizes(*a))
    transitions(bucketed.log, sizes=bucketed.sizes)
    assert not counted
    transitions(bucketed.log)
    assert len(counted) == 1


def test_a_hot_case_is_written_by_several_tasks_and_split(spark, tmp_path):
    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).cast("bigint").alias("case_id"),
                                   F.concat(F.lit("a"), F.col("id") % 4).alias("activity"),
                                   F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 1000)").alias("start_ts"),
                                   F.expr("timestamp_ntz'2020-01-01 01:00:00' + make_interval(0, 0, 0, 0, 0, id % 900)").alias("end_ts"),
                                   F.col("id").alias("event_id"))
    log, sizes, _ = read_bucketed_log(spark, write_bucketed_log(hot, str(tmp_path / "hot"), n_buckets=4, n_files=8))
    assert sizes.largest_case > 2000 and sizes.rows == 6000
    assert log.filter("case_id = 7").select(F.input_file_name()).distinct().count() > 1
    policy = SkewPolicy(hot_case_rows=1000, segment_rows=500)
    split = with_successor(log, policy=policy, sizes=sizes)
    assert "_seg" in split._jdf.queryExecution().toString()
    assert rows(split) == rows(with_successor(hot, policy=None))


def test_nulls_empty_log_overwriting_and_missing_input(spark, tmp_path):
    path = str(tmp_path / "log")
    few = events_as_log(spark, SF_SMALL).limit(50).cache()
    write_bucketed_log(few, path, n_buckets=3)
    nulls = few.withColumn("case_id", F.when(F.col("event_id") % 2 == 0, F.col("case_id")))
    log, sizes, _ = read_bucketed_log(spark, write_bucketed_log(nulls, path, n_buckets=2), table="named_log")
    assert rows(log) == rows(nulls) == rows(spark.table("named_log"))
    assert sizes.largest_case >= nulls.filter("case_id IS NULL").count()
    log, sizes, n = read_bucketed_log(spark, write_bucketed_log(few.limit(0), str(tmp_path / "none"), n_buckets=2))
    assert log.count() == 0 and sizes == CaseSizes(0, 0) and n == 2 and transitions(log, sizes=sizes).count() == 0
    with pytest.raises(FileNotFoundError):
        read_bucketed_log(spark, str(tmp_path / "nowhere"))
    spark.sql("DROP TABLE named_log")
