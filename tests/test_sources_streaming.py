"""Sinks, raw CSV scans and the streaming ingest."""

import os
import time

from pyspark.sql import functions as F

from pathweave.operators.clean import ingest_raw
from pathweave.operators.trace import transitions
from pathweave.sources.eventlog import (
    LOG_COLUMNS, TRANSITION_COLUMNS, events_as_log, read_dated_log, read_log, read_raw_csv, write_dated_log, write_log, write_transitions,
)
from pathweave.streaming import clean_stream, write_clean_stream

from conftest import SF_SMALL

RAW = ("ENCOUNTER ; START ;STOP; DESCRIPTION;OTHER\n"
       "n7;2019-08-03 06:10:00+00:00;2019-08-03 07:25:00+00:00;Hearing check;x\n"
       "n7;2019-08-03 09:00:00+00:00;2019-08-03 09:20:00+00:00;;y\n"
       "n8;bad;2019-08-03 10:00:00+00:00;Other;z\n")


def test_raw_csv_prunes_and_strips(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(RAW)
    raw = read_raw_csv(spark, str(p))
    assert raw.columns == ["ENCOUNTER", "START", "STOP", "DESCRIPTION"]
    log = ingest_raw(raw)
    assert log.count() == 2
    assert log.filter(F.col("activity") == "UNKNOWN_ACTIVITY").count() == 1


def test_log_and_transition_sinks(spark, tmp_path):
    log = events_as_log(spark, SF_SMALL)
    path = write_log(log, str(tmp_path / "log"), n_files=4)
    back = read_log(spark, path)
    assert back.count() == log.count()
    csvp = write_log(log, str(tmp_path / "logcsv"), fmt="csv", n_files=2)
    assert read_log(spark, csvp, fmt="csv", ntz=True).count() == log.count()
    tp = write_transitions(transitions(log), str(tmp_path / "trans"))
    t = spark.read.option("header", True).csv(tp)
    assert len(t.columns) == len(TRANSITION_COLUMNS) and "case:concept:name" in t.columns
    assert t.count() == transitions(log).count()


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(RAW)
    out = str(tmp_path / "out")
    q = write_clean_stream(clean_stream(spark, str(src)), out, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_transition_report_text(spark, tmp_path):
    """Cells are UTC text whatever the zone of the session."""
    rows = [("k1", "open", "2019-08-03 06:10:00", "2019-08-03 07:25:00", 0), ("k1", "close", "2019-08-03 08:00:00", "2019-08-03 08:30:00.5", 1)]
    log = spark.createDataFrame(rows, "case_id string, activity string, start_ts string, end_ts string, event_id long")
    want = ("k1,open,close,2019-08-03 06:10:00+00:00,2019-08-03 07:25:00+00:00,2019-08-03 08:00:00+00:00,"
            "35.0,35.0,{day},False,True,weekend")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone, day in (("UTC", "2019-08-03"), ("Asia/Tokyo", "2019-08-03"), ("America/New_York", "2019-08-03")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = log.withColumns({c: F.to_timestamp(F.concat(c, F.lit("+00:00"))) for c in ("start_ts", "end_ts")})
            p = write_transitions(transitions(at), str(tmp_path / zone.replace("/", "-")))
            assert [r[0] for r in spark.read.text(p).collect() if r[0].startswith("k1")] == [want.format(day=day)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_csv_round_trip_keeps_ties_quotes_and_line_breaks(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2020, 2, 2, 8)
    labels = ['say "hi"; done', "two\nlines", "comma, here", 'a "quoted" \n break'] + [f"a{i}" for i in range(4, 14)]
    rows = [("c", label, at, at, i) for i, label in enumerate(labels)]
    log = spark.createDataFrame(rows, "case_id string, activity string, start_ts timestamp_ntz, end_ts timestamp_ntz, event_id long")
    path = write_log(log, str(tmp_path / "log"), fmt="csv", n_files=2)
    back = read_log(spark, path, fmt="csv", ntz=True, multiline=True)
    assert dict(back.dtypes)["event_id"] == "bigint"
    from pathweave.operators.dfg import dfg_edges
    assert {(r["src"], r["dst"]) for r in dfg_edges(back).collect()} == set(zip(labels, labels[1:]))


def test_feature_store_round_trip(spark, tmp_path):
    import pytest

    from pathweave.operators.features import case_features
    from pathweave.plans import modeling
    from pathweave.sources.eventlog import read_features, write_features

    t = F.col("activity")
    log = events_as_log(spark, SF_SMALL).withColumn(
        "activity", F.when(F.col("event_id") % 2 == 0, F.concat(t, F.lit(".b`c"))).otherwise(F.when(F.col("event_id") % 3 == 0, F.upper(t)).otherwise(t)))
    write_features(case_features(log, 50), str(tmp_path / "encounter_features.parquet"))
    back = read_features(spark, str(tmp_path))
    assert back.count() == case_features(log, 50).count() and len([c for c in back.columns if c.startswith("proc_count__")]) == 15
    model = modeling.train(back, "encounter_duration_minutes", params={"maxIter": 2, "maxDepth": 2})
    assert modeling.score(model, back).count() == back.count()
    with pytest.raises(FileNotFoundError):
        read_features(spark, str(tmp_path / "none"))


def test_streaming_restart_is_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    body = ("ENCOUNTER;START;STOP;DESCRIPTION\n"
            "{c};2019-08-03 06:10:00+00:00;2019-08-03 07:25:00+00:00;a\n"
            "{c};2019-08-04 09:00:00+00:00;2019-08-04 09:30:00+00:00;b\n")
    (src / "f1.csv").write_text(body.format(c="e1"))
    (src / "f2.csv").write_text(body.format(c="e2"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    write_clean_stream(clean_stream(spark, str(src), max_files_per_trigger=1), out, checkpoint=ckpt) \
        .awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    (src / "f3.csv").write_text(body.format(c="e3"))     # new data after a stop
    write_clean_stream(clean_stream(spark, str(src), max_files_per_trigger=1), out, checkpoint=ckpt) \
        .awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 6 and df.select("event_id").distinct().count() == 6
    assert sorted(r["case_id"] for r in df.select("case_id").distinct().collect()) == ["e1", "e2", "e3"]


def test_write_log_files_are_sorted_and_range_split(spark, tmp_path):
    from pyspark.sql import functions as F
    log = events_as_log(spark, SF_SMALL)
    path = write_log(log, str(tmp_path / "log"), n_files=4)
    df = spark.read.parquet(path).withColumn("_f", F.input_file_name())
    keys = ["case_id", "start_ts", "end_ts", "event_id"]
    ranges = []
    for f in [r["_f"] for r in df.select("_f").distinct().collect()]:
        rows = [tuple(r) for r in spark.read.parquet(f).select(*keys).collect()]
        assert rows == sorted(rows)               # each file sorted by the trace order
        ranges.append((rows[0], rows[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))   # files hold disjoint key ranges


def scanned_files(df):
    """Number of data files that a plan with one scan reads, and its text."""
    df = df.select(F.input_file_name().alias("f")).distinct()
    return df.count(), df._jdf.queryExecution().toString()


def test_dated_log_reads_only_the_dates_asked_for(spark, tmp_path):
    log = events_as_log(spark, SF_SMALL)
    extra = spark.createDataFrame([(1, "none", 5)], "case_id bigint, activity string, event_id bigint")
    both = log.unionByName(extra, allowMissingColumns=True)
    path = write_dated_log(both, str(tmp_path / "dated"))
    every = read_dated_log(spark, path)
    rows = sorted(map(tuple, every.select(*LOG_COLUMNS).collect()), key=str)
    assert rows == sorted(map(tuple, both.select(*LOG_COLUMNS).collect()), key=str)
    n_every, _ = scanned_files(every)
    dates = sorted(r[0] for r in log.select(F.to_date("start_ts")).distinct().collect())
    day = dates[len(dates) // 2]
    week = f"{day.year:04d} - Week {int(day.strftime('%U')):02d}"
    asked = {
        "days": (read_dated_log(spark, path, first=day, last=str(day)), lambda x: x == day),
        "later": (read_dated_log(spark, path, first=day), lambda x: x >= day),
        "week": (read_dated_log(spark, path, week=week), lambda x: x.strftime("%Y - Week %U") == week),
        "weekend": (read_dated_log(spark, path, day_types=["Weekend", "Holiday"]), None),
        "weekday": (read_dated_log(spark, path, day_types=["Weekday"]), None),
    }
    counts = {}
    for name, (df, keep) in asked.items():
        n, plan = scanned_files(df)
        assert 0 < n < n_every and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan, name
        counts[name] = df.count()
        if keep:
            assert counts[name] == sum(keep(r[0]) for r in log.select(F.to_date("start_ts")).collect())
    assert counts["weekend"] + counts["weekday"] == log.count()


def test_dated_log_without_rows_and_wrong_names(spark, tmp_path):
    import pytest

    log = events_as_log(spark, SF_SMALL)
    path = write_dated_log(log.limit(0), str(tmp_path / "empty"))
    none = read_dated_log(spark, path, day_types=["Holiday"], schema=log.schema)
    assert none.count() == 0 and none.columns == [*log.columns, "start_date"]
    with pytest.raises(ValueError):
        read_dated_log(spark, path, day_types=["Sunday"], schema=log.schema)
    with pytest.raises(FileNotFoundError):
        read_dated_log(spark, str(tmp_path / "nowhere"))


def test_a_hot_date_is_split_over_files(spark, tmp_path):
    log = events_as_log(spark, SF_SMALL).withColumn("start_ts", F.lit("2024-07-04 08:00:00").cast("timestamp_ntz"))
    path = write_dated_log(log, str(tmp_path / "hot"), n_files=4)
    assert scanned_files(read_dated_log(spark, path))[0] > 1
