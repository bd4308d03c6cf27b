"""Scalar functions: calendar, labels, rounding, parsing, multi-hot."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pathweave.functions import (
    CLINICAL_RULES, collapse_labels, duration_label_to_minutes, is_holiday, multi_hot, normalise_text,
    parse_ts_strict, round2, year_week, with_holiday_table,
)
from pathweave.functions.labels import rules_are_order_safe


def _dates(spark, ds):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in ds], "d date")


def test_federal_holidays_and_observed_days(spark):
    hol = ["2021-12-31",  # New Year 2022 is a Saturday -> observed Friday before
           "2023-01-02",  # New Year 2023 is a Sunday -> observed Monday
           "2011-01-17", "2011-02-21", "2011-05-30", "2011-09-05", "2011-10-10", "2011-11-24",
           "2021-06-18",  # Juneteenth 2021 on Saturday
           "2020-07-03",  # July 4 2020 on Saturday
           "2017-11-10",  # Veterans Day 2017 on Saturday
           "2022-12-26",  # Christmas 2022 on Sunday
           ]
    not_hol = ["2011-01-10", "2020-06-19", "2011-04-18", "2011-05-23", "2011-12-24"]
    df = _dates(spark, hol + not_hol).select("d", is_holiday(F.col("d")).alias("h"))
    got = {str(r["d"]): r["h"] for r in df.collect()}
    assert all(got[d] for d in hol), got
    assert not any(got[d] for d in not_hol), got


def test_region_adds_patriots_day(spark):
    df = _dates(spark, ["2011-04-18"]).select(is_holiday(F.col("d"), "MA").alias("h"))
    assert df.first()["h"]


def test_holiday_table_join(spark):
    df = _dates(spark, ["2024-03-01", "2024-03-02"])
    hol = _dates(spark, ["2024-03-01"]).withColumnRenamed("d", "date")
    out = {str(r["d"]): r["is_holiday"] for r in with_holiday_table(df, "d", hol).collect()}
    assert out == {"2024-03-01": True, "2024-03-02": False}


def test_year_week_matches_strftime(spark):
    days = [dt.date(2019, 12, 25) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", year_week(F.col("d")).alias("w"))
    for r in df.collect():
        assert r["w"] == r["d"].strftime("%Y - Week %U")


def test_round2_is_numpy_style(spark):
    import numpy as np
    vals = [0.125, 1.015, 2.675, -0.125, 1.005, 123.456, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(round2("x")).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_strict_parse_raises(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00",), ("junk",)], "s string")
    with pytest.raises(Exception):
        df.select(parse_ts_strict("s")).collect()
    ok = spark.createDataFrame([("2020-01-01T00:00:00Z",), (None,)], "s string").select(parse_ts_strict("s"))
    assert ok.count() == 2


def test_clinical_rules(spark):
    text = [
        ("  Prenatal visit  ", "pregnancy & fetal care"),
        ("Patient Health Questionnaire 2 item (PHQ-2)", "mental/behavioral health"),
        ("Alcohol Use Disorders Identification Test - Consumption (AUDIT-C)", "substance/abuse screening"),
        ("Hemodialysis (procedure)", "renal/dialysis"),
        ("Teleradiotherapy procedure", "oncology therapy"),
        ("Electrocardiographic procedure", "cardiology procedures/tests"),
        ("Plain chest X-ray (procedure)", "imaging tests"),
        ("Screening for HIV", "lab tests / std panel"),
        ("hiv-free 'xhivx' check", "lab tests / std panel"),
        ("xhivx check", "xhivx check"),
        ("Medication Reconciliation (procedure)", "medication reconciliation (procedure)"),
        ("renal/dialysis", "renal/dialysis"),
    ]
    df = spark.createDataFrame([(t,) for t, _ in text], "s string")
    got = [r[0] for r in df.select(collapse_labels(normalise_text("s"), CLINICAL_RULES)).collect()]
    assert got == [e for _, e in text]
    assert rules_are_order_safe(CLINICAL_RULES)


def test_sequential_equals_case_form():
    import re
    rules = CLINICAL_RULES
    samples = ["prenatal", "ecg monitoring", "x-ray of knee", "hepatitis b screening", "other"]
    for s in samples:
        v = s
        for rx, lab in rules:
            v = re.sub(rx, lab, v)
            if lab in v:
                v = lab
        first = next((lab for rx, lab in rules if re.search(rx, s) or lab in s), s)
        assert v == first


def test_duration_labels(spark):
    cases = [("3h", "180.00 min"), ("90s", "1.50 min"), ("2D", "2880.00 min"), ("12m", "12.00 min"),
             ("1.5 h", "90.00 min"), ("5w", "5w"), ("abc", "abc")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "s string")
    assert [r[0] for r in df.select(duration_label_to_minutes("s")).collect()] == [b for _, b in cases]


def test_multi_hot_ignores_unknown_and_duplicates(spark):
    df = spark.createDataFrame([(["a", "a", "zzz"],)], "p array<string>")
    r = df.select(*multi_hot("p", ["a", "b"])).first()
    assert (r["proc_count__a"], r["proc_count__b"]) == (1, 0)


def test_round_exact_is_python_round(spark):
    import random
    rnd = random.Random(1)
    vals = [83.325, 1.015, 2.675, 0.125, 0.375, -0.125, -83.325, 1.005, 1e-9, 12345.675, 0.0]
    vals += [round(rnd.uniform(-5000, 5000), 3) for _ in range(3000)]
    vals += [(rnd.randrange(0, 10**6) + 0.5) / 100 for _ in range(2000)]
    from pathweave.functions.timefns import round_exact
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_exact("x", 2)).collect()]
    assert got == [round(v, 2) for v in vals]
    assert [r[0] for r in df.select(F.format_string("%.2f", round_exact("x", 2))).collect()] == \
        [f"{v:.2f}" for v in vals]


def _python_holidays(year, region=None):
    """Independent reference: US federal holidays (observed) from datetime arithmetic."""
    import calendar as cal
    out = set()

    def nth(month, weekday, n):
        days = [d for d in range(1, cal.monthrange(year, month)[1] + 1)
                if dt.date(year, month, d).weekday() == weekday]
        return dt.date(year, month, days[n - 1] if n > 0 else days[-1])

    def fixed(month, day):
        d = dt.date(year, month, day)
        out.add(d)
        if d.weekday() == 5:
            out.add(d - dt.timedelta(days=1))
        elif d.weekday() == 6:
            out.add(d + dt.timedelta(days=1))

    fixed(1, 1)
    if year >= 2021:
        fixed(6, 19)
    fixed(7, 4)
    fixed(11, 11)
    fixed(12, 25)
    out |= {nth(1, 0, 3), nth(2, 0, 3), nth(5, 0, -1), nth(9, 0, 1), nth(10, 0, 2), nth(11, 3, 4)}
    if region == "MA":
        out.add(nth(4, 0, 3))
    return out


def test_holidays_match_independent_python(spark):
    start, end = dt.date(1990, 1, 1), dt.date(2035, 12, 31)
    n = (end - start).days + 1
    df = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    for region in (None, "MA"):
        got = {r["d"] for r in df.filter(is_holiday(F.col("d"), region)).collect()}
        exp = set()
        for y in range(1989, 2037):
            exp |= {d for d in _python_holidays(y, region) if start <= d <= end}
        assert got == exp, (region, sorted(got ^ exp)[:10])


def test_relabel_distinct_equals_the_rules_on_every_row(spark):
    from pathweave.operators.clean import relabel_distinct

    texts = ["  Follow-up  encounter", "follow-up encounter", "Death certification", None, "", "Other", " other "]
    rows = [(i, texts[i % len(texts)] if i % 3 else "Other", i) for i in range(500)]         # a third of the rows has one label
    df = spark.createDataFrame(rows, "n int, activity string, `_old` int").repartition(4)

    def rule(c):
        return collapse_labels(normalise_text(c), CLINICAL_RULES)

    got = relabel_distinct(df, rule)
    assert got.columns == df.columns
    want = sorted(map(tuple, df.withColumn("activity", rule(F.col("activity"))).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 500
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, relabel_distinct(df, rule).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert relabel_distinct(df.limit(0), rule).count() == 0
    with pytest.raises(ValueError):
        relabel_distinct(df, rule, "label")


def test_relabel_distinct_computes_rules_after_the_aggregation(spark, tmp_path):
    from pathweave.operators.clean import relabel_distinct

    spark.range(100).selectExpr("id", "concat('Label ', id % 5) AS activity").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = relabel_distinct(log, lambda c: F.regexp_replace(c, "l(a)", "$1"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    rule = next(i for i, x in enumerate(lines) if "regexp_replace" in x)
    assert "Aggregate" in lines[rule] or any("Aggregate" in x for x in lines[rule + 1:rule + 2])
    assert plan.count("regexp_replace") == 1
