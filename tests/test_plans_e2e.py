"""Stage-level plans: ingest -> discovery, dashboard from a raw file."""

from pyspark.sql import functions as F

from pathweave.plans.dashboard import dashboard_views, service_log
from pathweave.plans.discovery import discover_from_file
from pathweave.plans.ingest import ingest_and_write

RAW = ("ENCOUNTER;START;STOP;DESCRIPTION;CODE\n"
       "m1;2020-03-09 20:00:00+00:00;2020-03-09 21:30:00+00:00;Hemodialysis session;1\n"
       "m1;2020-03-10 07:15:00+00:00;2020-03-10 07:45:00+00:00;Diet Counselling;2\n"
       "m1;2020-03-10 08:00:00+00:00;2020-03-10 08:20:00+00:00;;3\n"
       "m2;2020-01-20 10:00:00+00:00;2020-01-20 10:30:00+00:00;Mammography, both sides;4\n"
       "m2;2020-01-20 11:00:00+00:00;bad;Platelet count;5\n"
       "m2;2020-01-20 11:10:00+00:00;2020-01-20 11:20:00+00:00;Platelet count;6\n"
       "m3;2020-02-04 09:00:00+00:00;2020-02-04 09:10:00+00:00;Solo;7\n")


def test_ingest_then_discover(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(RAW)
    out = ingest_and_write(spark, str(raw), str(tmp_path / "log"), fmt="csv", n_cases=2)
    d = discover_from_file(spark, out)
    trans = {(r["case_id"], r["activity"]): r for r in d.transitions.collect()}
    assert len(trans) == 3  # m1: 2 transitions, m2: 1 (bad row dropped); m3 is not among the first two cases
    first = trans[("m1", "renal/dialysis")]
    assert first["next_activity"] == "diet counselling"
    assert first["raw_gap_min"] == 585.0 and first["day_type"] == "weekday"
    assert trans[("m2", "imaging tests")]["day_type"] == "holiday"  # third Monday of January 2020
    assert trans[("m1", "diet counselling")]["next_activity"] == "unknown_activity"
    assert {r["activity"]: r["n"] for r in d.starts.collect()} == {"renal/dialysis": 1, "imaging tests": 1}
    assert d.edges.agg(F.sum("n")).first()[0] == 3


def test_ingest_keeps_all_cases_unless_asked(spark, tmp_path):
    from pathweave.plans.ingest import ingest_log
    raw = tmp_path / "raw.csv"
    raw.write_text("ENCOUNTER;START;STOP;DESCRIPTION\n" + "".join(
        f"p{i};2020-03-09 20:00:00+00:00;2020-03-09 21:30:00+00:00;a\n" for i in range(80)))
    assert ingest_log(spark, str(raw)).select("case_id").distinct().count() == 80


def test_first_cases_follow_the_order_of_files(spark, tmp_path):
    from pathweave.plans.ingest import ingest_log
    line = "{};2020-03-09 20:00:00+00:00;2020-03-09 21:30:00+00:00;a\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "part-a.csv").write_text("ENCOUNTER;START;STOP;DESCRIPTION\n" + line.format("e1"))
    (tmp_path / "raw" / "part-b.csv").write_text("ENCOUNTER;START;STOP;DESCRIPTION\n" + line.format("e2") * 50)
    assert {r["case_id"] for r in ingest_log(spark, str(tmp_path / "raw"), n_cases=1).collect()} == {"e1"}


def test_dashboard_from_raw(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(RAW)
    v = dashboard_views(service_log(spark, str(raw)), tod="Day (06-18)")
    k = v.kpis.first()
    assert k["n_patients"] == 5  # day-time rows (06-18) with both times parsed
    assert v.daily.count() == 7 and v.forecast.count() == 168
    f = {(r["day_no"], r["arrival_hour"]): r["predicted_min"] for r in v.forecast.collect()}
    assert f[(0, 11)] == 10.0      # Monday 11:10-11:20
    assert f[(2, 3)] == 30.0       # empty slot -> fallback


def test_ingest_keeps_first_cases_in_file_order(spark, tmp_path):
    from pathweave.plans.ingest import ingest_log
    raw = tmp_path / "raw.csv"
    # z appears first in the file but starts latest
    raw.write_text("ENCOUNTER;START;STOP;DESCRIPTION\n"
                   "z;2011-03-01 00:00:00+00:00;2011-03-01 01:00:00+00:00;a\n"
                   "y;2011-01-01 00:00:00+00:00;2011-01-01 01:00:00+00:00;a\n"
                   "x;2011-02-01 00:00:00+00:00;2011-02-01 01:00:00+00:00;a\n")
    assert {r["case_id"] for r in ingest_log(spark, str(raw), n_cases=2).collect()} == {"z", "y"}


def test_write_reports(spark, tmp_path):
    from pathweave.plans.discovery import write_reports
    raw = tmp_path / "raw.csv"
    raw.write_text(RAW)
    out = ingest_and_write(spark, str(raw), str(tmp_path / "log"), fmt="csv", n_cases=None)
    paths = write_reports(discover_from_file(spark, out), str(tmp_path / "reports"))
    assert set(paths) == {"waiting_transitions", "edges", "starts", "ends", "performance",
                          "wait_summary", "box_stats", "ecdf"}
    assert spark.read.parquet(paths["wait_summary"]).count() == 7
    rep = spark.read.option("header", True).csv(paths["waiting_transitions"])
    assert "case:concept:name" in rep.columns and rep.count() == 3  # m1: 2, m2: 1, m3: none
