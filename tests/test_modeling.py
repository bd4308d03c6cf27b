"""Model contracts: load, chronological split, train, evaluate, save, orchestrate."""

import datetime as dt

from pyspark.sql import functions as F

from pathweave.plans import modeling
from pathweave.sources.eventlog import events_as_log

from conftest import SF, SF_SMALL

SMALL = dict(maxIter=3, stepSize=0.1, maxDepth=2, seed=42)


def test_chronological_split(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, d), float(10 * d)) for d in range(1, 5)],
                               "encounter_start timestamp, encounter_duration_minutes double")
    tr, va = modeling.split_frames(modeling.chrono_split_flag(df, "encounter_start", 0.25))
    assert tr.count() == 3 and va.count() == 1
    assert va.agg(F.min("encounter_start")).first()[0] > tr.agg(F.max("encounter_start")).first()[0]


def test_random_split_is_stable(spark):
    rows = modeling.training_rows(events_as_log(spark, SF_SMALL))
    a = modeling.random_split_flag(rows).filter("split = 'train'").count()
    b = modeling.random_split_flag(rows.repartition(7)).filter("split = 'train'").count()
    n = rows.count()
    assert a == b and 0.75 * n < a < 0.85 * n


def test_train_evaluate_save_load(spark, tmp_path):
    df = spark.createDataFrame([(10.0, 1), (20.0, 0), (30.0, 1)], "encounter_duration_minutes double, proc_count__a int")
    model = modeling.train(df, "encounter_duration_minutes", params=SMALL)
    assert hasattr(model, "transform")
    m = modeling.evaluate(model, df, "encounter_duration_minutes")
    assert "mae" in m
    paths = modeling.save_artifacts(str(tmp_path / "models"), model, m)
    assert set(paths) == {"model", "metrics"}
    back = modeling.load_model(str(tmp_path / "models"))
    assert back.transform(df).count() == 3
    scored = modeling.score(back, df).collect()
    assert all(round(r["predicted_min"], 2) == r["predicted_min"] for r in scored)


def test_mae_arithmetic(spark):
    df = spark.createDataFrame([(10.0, 10.0), (20.0, 10.0)], "y double, prediction double")
    assert modeling.mae_of(df, "y").first()["mae"] == 5.0


def test_trainer_orchestrates(spark, tmp_path):
    def load():
        return spark.createDataFrame(
            [(dt.datetime(2020, 1, d), float(d * 7 % 11), d % 2) for d in range(1, 21)],
            "encounter_start timestamp, encounter_duration_minutes double, proc_count__a int")
    t = modeling.Trainer(load=load, model_dir=str(tmp_path / "m"), params=SMALL)
    out = t.run()
    assert str(tmp_path / "m") in out["model"]


def test_training_table_from_raw(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(" START ;STOP ;DESCRIPTION\n"
                 "2020-01-06T10:00:00Z;2020-01-06T10:30:00Z;a\n"
                 "2020-01-06T11:00:00Z;2020-01-06T10:30:00Z;b\n"
                 "junk;2020-01-06T10:30:00Z;c\n")
    rows = modeling.training_table_from_raw(spark, str(p)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["Waiting_Time_Mins"], r["Day_Index"], r["Arrival_Hour"]) == (30.0, 0, 10)


def test_model_queries_fit_with_the_full_settings(spark, monkeypatch):
    import __spark_entry__ as entry

    fitted, train = [], modeling.train

    def noted(*args, **kwargs):
        fitted.append(train(*args, **kwargs).stages[-1])
        raise InterruptedError                                     # the model is all that is looked at

    monkeypatch.setattr(modeling, "train", noted)
    for name in ("q_gbt_mae", "q_predict_procs"):
        try:
            entry.queries()[name](spark, SF_SMALL)
        except InterruptedError:
            pass
    assert [m.getNumTrees for m in fitted] == [modeling.GBT_PARAMS["maxIter"]] * 2


def test_weighted_cells_give_the_model_of_the_rows(spark):
    rows = modeling.training_rows(events_as_log(spark, SF))
    params = dict(maxIter=4, stepSize=0.1, maxDepth=3, seed=42)
    label, names = "Waiting_Time_Mins", modeling.CALENDAR_FEATURES
    grid = modeling.cells(rows, label, names)
    a, b = ({(r["Day_Index"], r["Arrival_Hour"]): r["prediction"] for r in m.transform(grid).collect()}
            for m in (modeling.train(rows, label, names, params), modeling.train_on_cells(rows, label, names, params)))
    assert len(a) == 168 and all(abs(a[k] - b[k]) < 1e-9 * abs(a[k]) for k in a) and len(set(a.values())) > 8
    assert grid.agg(F.sum("rows")).first()[0] == rows.count()


def test_split_of_one_tree(spark):
    rows = spark.createDataFrame([(0, h, 10.0 if h < 7 else 50.0) for h in range(24)] * 3, "Day_Index int, Arrival_Hour int, y double")
    model = modeling.train_on_cells(rows, "y", modeling.CALENDAR_FEATURES, dict(maxIter=1, maxDepth=1, seed=1))
    assert modeling.first_split(model, modeling.CALENDAR_FEATURES) == ("Arrival_Hour", 6.5)
    assert {r["predicted_min"] for r in modeling.score(model, rows).collect()} == {10.0, 50.0}
    flat = modeling.train_on_cells(rows, "y", modeling.CALENDAR_FEATURES, dict(maxIter=1, maxDepth=0, seed=1))
    assert modeling.first_split(flat, modeling.CALENDAR_FEATURES) is None


def test_a_constant_model_turns_the_split_queries_red(spark, monkeypatch):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_SMALL}/events.parquet'")

    def rows(name):
        got = entry.queries()[name](spark, SF_SMALL)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect())), sorted(want), got.columns.index("predicted_min")

    names = ("q_stump_calendar", "q_stump_procs", "q_model_store")
    for name in names:
        got, want, at = rows(name)
        assert got == want and len({r[at] for r in got}) == 2, name
    monkeypatch.setattr(entry, "STUMP_PARAMS", {**entry.STUMP_PARAMS, "maxDepth": 0})       # the mean everywhere
    for name in names:
        got, want, _ = rows(name)
        assert got != want, name
