"""Statistics and dashboard operators against numpy / pandas on small inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathweave.operators import ops, stats
from pathweave.sources.eventlog import events_as_log

from conftest import SF


def _long(spark, groups):
    rows = [(d, g, float(v)) for (d, g), vals in groups.items() for v in vals]
    return spark.createDataFrame(rows, "dimension string, grp string, value double")


def test_quantiles_match_numpy_and_empty_group(spark):
    vals = [0.0, 5.0, 1.5, 7.25, 1.5, 100.0, 33.3, -2.0]
    long = _long(spark, {("time_of_day", "day"): vals})
    out = {(r["dimension"], r["grp"]): r for r in
           stats.quantile_summary(stats.value_counts(long), stats.group_dim(spark)).collect()}
    pos = np.array([v for v in vals if v > 0])
    r = out[("time_of_day", "day")]
    assert r["n"] == len(pos)
    for name, q in [("median", .5), ("p90", .9), ("p95", .95), ("p99", .99)]:
        assert r[name] == round(float(np.quantile(pos, q)), 2)
    assert out[("day_type", "holiday")]["n"] == 0 and out[("day_type", "holiday")]["median"] is None


def test_box_stats_match_matplotlib_rules(spark):
    vals = [1, 2, 2, 3, 4, 5, 6, 200]
    long = _long(spark, {("weekend", "weekday"): vals})
    logc = stats.value_counts(long, transform=lambda v: F.log(F.lit(1.0) + v))
    r = [x for x in stats.box_stats(logc, stats.group_dim(spark)).collect() if x["grp"] == "weekday"
         and x["dimension"] == "weekend"][0]
    lv = np.log(np.array(vals, dtype=float) + 1)
    q1, med, q3 = np.percentile(lv, [25, 50, 75])
    iqr = q3 - q1
    inside = lv[(lv >= q1 - 1.5 * iqr) & (lv <= q3 + 1.5 * iqr)]
    assert abs(r["q1"] - q1) < 1e-12 and abs(r["median"] - med) < 1e-12 and abs(r["q3"] - q3) < 1e-12
    assert abs(r["mean"] - lv.mean()) < 1e-12
    assert r["whisker_lo"] == inside.min() and r["whisker_hi"] == inside.max()
    assert r["n_outliers"] == len(lv) - len(inside)


def test_ecdf_steps(spark):
    long = _long(spark, {("weekend", "weekend"): [3, 1, 3, 2]})
    rows = stats.ecdf(stats.value_counts(long)).orderBy("value").collect()
    assert [(r["value"], r["y"]) for r in rows] == [(1.0, 0.25), (2.0, 0.5), (3.0, 1.0)]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.exponential(30, 500), [0.5, 0.5, 400.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    h = stats.histogram(df, "v", 50).collect()
    counts, edges = np.histogram(vals, bins=50)
    assert [r["n"] for r in h] == list(counts)
    assert np.allclose([r["lo"] for r in h], edges[:-1])


def test_describe_and_cap(spark):
    vals = [1.0, 2.0, 3.0, 10.0, 50.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    d = stats.describe(df, "v").first()
    s = pd.Series(vals).describe()
    assert d["count"] == 5 and abs(d["std"] - s["std"]) < 1e-12 and d["p50"] == s["50%"]
    cap = np.quantile(vals, 0.99)
    got = sorted(r["v_capped"] for r in stats.quantile_cap(df, "v", 0.99).collect())
    assert got == sorted(min(v, cap) for v in vals)


def test_dashboard_views(spark):
    sv = ops.service_view(events_as_log(spark, SF))
    assert ops.daily_mean(sv).count() == 7
    assert ops.slot_forecast(sv).count() == 168
    assert ops.heatmap(sv).count() == 7 and len(ops.heatmap(sv).columns) == 26
    cube = {(r["time_filter"], r["week_filter"], r["day_type_filter"]): r for r in ops.kpi_cube(sv).collect()}
    total = cube[("All Day", "All Weeks", "All")]
    assert total["n_patients"] == 10000
    night = ops.kpis(ops.filter_view(sv, ops.TOD_NIGHT, ops.WEEK_ALL, "Weekday")).first()
    assert night["n_patients"] == cube[("Night (18-06)", "All Weeks", "Weekday")]["n_patients"]
    wk = ops.weeks(sv).first()["year_week"]
    one = ops.kpis(ops.filter_view(sv, week=wk)).first()
    assert one["n_patients"] == cube[("All Day", wk, "All")]["n_patients"]


def test_slot_fallback(spark):
    import datetime as dt
    log = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 12), 0)],
                                "case_id long, activity string, start_ts timestamp, end_ts timestamp, event_id long")
    f = {(r["day_no"], r["arrival_hour"]): r for r in ops.slot_forecast(ops.service_view(log)).collect()}
    assert f[(0, 10)]["predicted_min"] == 120.0 and f[(0, 10)]["congested"]
    assert f[(3, 4)]["predicted_min"] == 30.0 and not f[(3, 4)]["congested"]


def _rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def _quantiles(df, keys=(), **small):
    return {tuple(r[k] for k in keys): (r["n"], r["_q"]) for r in stats.group_quantiles(df, keys, PROBS, **small).collect()}


def test_bracketed_quantiles_equal_numpy(spark):
    """Whatever the passes: nearly unique, tied, skewed and constant groups."""
    rng = np.random.default_rng(11)
    groups = {"unique": rng.normal(size=4000), "tied": rng.integers(0, 5, 3000).astype(float),
              "skewed": np.exp(rng.normal(0, 8, 2000)), "constant": np.full(500, 7.25), "one": np.array([3.5]),
              "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("unique", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = _quantiles(df, ["g"])
    assert got[(None,)] == (1, [4.0] * len(PROBS))
    for g, vs in groups.items():
        want = (len(vs), [float(np.quantile(vs, p)) for p in PROBS])
        assert got[(g,)] == want, g
        for margin in (stats.SKETCH_MARGIN, -0.3):                # too small a margin: all values are counted
            assert _quantiles(df.filter(F.col("g") == g).select("value"), margin=margin) == {(): want}, (g, margin)


def test_plain_rows_are_read_twice_and_few_are_shuffled(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=200_000)
    df = spark.createDataFrame(pd.DataFrame({"value": vals}))
    near = stats._near_ranks(df, [0.25, 0.5, 0.75], stats.SKETCH_MARGIN)
    rows = near.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("one")).alias("gaps")).first()
    assert rows["n"] == vals.size and rows["gaps"] <= 4 and rows["rows"] < 0.1 * vals.size
    assert _quantiles(df) == {(): (vals.size, [float(np.quantile(vals, p)) for p in PROBS])}


def test_running_counts_of_many_intervals(spark):
    rng = np.random.default_rng(5)
    vals = {"a": np.round(rng.exponential(50, 30_000), 2), "b": np.full(900, 1.0), None: rng.integers(0, 9, 50).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in vals.items() for v in vs], "g string, value double")
    run = stats.cumulative_counts(df.groupBy("g", "value").agg(F.count(F.lit(1)).alias("cnt")), ["g"]).toPandas()
    for g, vs in vals.items():
        mine = run[run["g"].isna() if g is None else run["g"] == g].sort_values("value")
        v, c = np.unique(vs, return_counts=True)
        assert mine["value"].tolist() == v.tolist() and mine["n_le"].tolist() == np.cumsum(c).tolist() and set(mine["n"]) == {len(vs)}


def test_quantiles_of_counted_values(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 8.0, 2.5]
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    counted = df.groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))
    assert _quantiles(counted) == _quantiles(df) == {(): (6, [float(np.quantile(vals, p)) for p in PROBS])}
    assert _quantiles(counted.filter("value > 100")) == {}


def test_kpi_cube_equals_each_filter(spark):
    sv = ops.service_view(events_as_log(spark, SF)).cache()
    cube = {(r["time_filter"], r["week_filter"], r["day_type_filter"]): r for r in ops.kpi_cube(sv).collect()}
    weeks = [r["year_week"] for r in ops.weeks(sv).collect()]
    for tod in (ops.TOD_ALL, ops.TOD_DAY, ops.TOD_NIGHT):
        for wk in [ops.WEEK_ALL] + weeks[:2]:
            for dtp in (ops.DAYTYPE_ALL, "Weekday", "Weekend", "Holiday"):
                k = ops.kpis(ops.filter_view(sv, tod, wk, dtp)).first()
                c = cube.get((tod, wk, dtp))
                if k["n_patients"] == 0:
                    assert c is None
                    continue
                assert c["n_patients"] == k["n_patients"]
                assert abs(c["avg_wait_min"] - k["avg_wait_min"]) < 1e-9 * max(1.0, abs(k["avg_wait_min"]))
    sv.unpersist()


def test_describe_and_ecdf_match_pandas(spark):
    from conftest import SF_SMALL
    from pathweave.functions.timefns import minutes_between
    from pathweave.operators.trace import transitions
    log = events_as_log(spark, SF_SMALL)
    dur = log.select(minutes_between("start_ts", "end_ts").alias("d"))
    pdv = dur.toPandas()["d"]
    d = stats.describe(dur, "d").first()
    ref = pdv.describe()
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(d[ours] - ref[theirs]) <= 1e-9 * max(1.0, abs(ref[theirs])), ours
    long = stats.wait_groups_long(transitions(log))
    e = stats.ecdf(stats.value_counts(long)).toPandas()
    lp = long.toPandas()
    lp = lp[lp["value"] > 0]
    for (dim, grp), g in lp.groupby(["dimension", "grp"]):
        v = np.sort(np.repeat(g["value"].to_numpy(), g["cnt"].to_numpy()))
        mine = e[(e["dimension"] == dim) & (e["grp"] == grp)].sort_values("value")
        exp_y = [np.searchsorted(v, x, side="right") / len(v) for x in mine["value"]]
        assert np.allclose(mine["y"].to_numpy(), exp_y)
        assert len(mine) == len(np.unique(v))


def test_wait_summary_equals_numpy(spark):
    """Exact equality, also where a rounding hangs on the last bit."""
    from pathweave.operators.trace import transitions
    tr = transitions(events_as_log(spark, SF))
    out = stats.quantile_summary(stats.value_counts(stats.wait_groups_long(tr)), stats.group_dim(spark)).toPandas()
    raw = tr.select("waiting_min", F.hour("start_ts").alias("hour"), "is_weekend", "day_type").toPandas()
    member = {"time_of_day": np.where(raw["hour"].between(6, 17), "day", "night"),
              "weekend": np.where(raw["is_weekend"], "weekend", "weekday"), "day_type": raw["day_type"].to_numpy()}
    waits = raw["waiting_min"].to_numpy(dtype=float)
    for _, r in out.iterrows():
        mine = waits[(member[r["dimension"]] == r["grp"]) & (waits > 0)]
        assert r["n"] == mine.size
        for column, p in zip(("median", "p90", "p95", "p99"), stats.SUMMARY_PROBS, strict=True):
            assert r[column] == round(float(np.quantile(mine, p)), 2), (r["dimension"], r["grp"], column)
