"""

``entry(spark)`` runs the flagship query (the transition table) on sf0.001.
``queries()`` maps each operator of the inventory to a callable
``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` gives the same result as
DuckDB SQL over the pre-registered tables.  Every column is aliased to the
same name on both sides.

Fixture mapping (the event log): case = events.user_id,
activity = events.event_type, start = events.ts,
end = ts + value minutes (rounded to the microsecond), tie-break = event_id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.calendar import (
    day_name, is_holiday, is_weekend, time_of_day, weekday_index, year_week, day_type,
)
from pathweave.functions.encode import multi_hot
from pathweave.functions.labels import CLINICAL_RULES, collapse_labels, duration_label_to_minutes, normalise_text
from pathweave.functions.timefns import minutes_between
from pathweave.operators import clean, dfg, features, heavy, ops, sparse, stats
from pathweave.operators.trace import transitions
from pathweave.plans.discovery import normalise_log
from pathweave.plans import modeling
from pathweave.plans.featurize import build_features
from pathweave.plans.ingest import ingest_log
from pathweave.session import shared_path
from pathweave.sources.bucketed import read_bucketed_log, write_bucketed_log
from pathweave.sources.eventlog import (
    csv_options, events_as_log, read_dated_log, read_features, read_log, write_dated_log, write_log, write_transitions,
)

SMOKE_DIR = "/root/testdata/sf0.001"

# Query parameters (the reference's own values where it has them).
COHORT_N = 50          # first-N-cases cohort
MIN_EVENTS = 2         # minimum case size
TOP_K = 50             # activity-count pivot
TOPK_ROWS_K = 3        # top-k membership filter
VAL_FRACTION = 0.25    # chronological split
DURATION_BOX_K = 10    # box statistics for the top-10 activities
REGION = "MA"          # holiday region for the transition table
# A user-supplied rule list for label collapsing, applied to part names.
PART_RULES = [
    (r"\bgreen\b|olive|lime|forest", "greens"),
    (r"metallic|steel|chrome", "metals"),
    (r"\b(red|rose|pink)\b", "reds"),
]
# The five activities of the fixture log (its whole vocabulary).
VOCAB = ["click", "error", "purchase", "signup", "view"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _log(spark, sf_dir):
    return events_as_log(spark, sf_dir)


def _nlog(spark, sf_dir):
    return normalise_log(_log(spark, sf_dir), CLINICAL_RULES)


# ----------------------------------------------------------------- queries

def q_load_log(spark, d):
    return _log(spark, d)


def _raw_text(spark, d):
    ev = _t(spark, d, "events")
    end = F.timestamp_add("MICROSECOND", F.round(F.col("value") * F.lit(60_000_000)).cast("bigint"), F.col("ts"))
    return ev.select(
        F.col("user_id").cast("string").alias("ENCOUNTER"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 300), F.lit("n/a"))
        .otherwise(F.col("ts").cast("string")).alias("START"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 300), F.lit("2024-02-30 10:00:00"))
        .otherwise(end.cast("string")).alias("STOP"),
        F.nullif(F.col("event_type"), F.lit("signup")).alias("DESCRIPTION"),
        "event_id")


def q_clean_log(spark, d):
    raw = _raw_text(spark, d)
    return clean.ingest_raw(raw, ntz=True, id_col="event_id")


def q_first_n_cases(spark, d):
    return clean.first_n_cases(_log(spark, d), COHORT_N)


def q_min_case_size(spark, d):
    return clean.min_case_size(_log(spark, d), MIN_EVENTS)


def q_transitions(spark, d):
    return transitions(_nlog(spark, d), region=REGION)


def q_dfg_edges(spark, d):
    return dfg.dfg_edges(_nlog(spark, d))


def q_dfg_starts(spark, d):
    return dfg.dfg_start_activities(_nlog(spark, d), MIN_EVENTS)


def q_dfg_ends(spark, d):
    return dfg.dfg_end_activities(_nlog(spark, d), MIN_EVENTS)


def q_dfg_performance(spark, d):
    return dfg.dfg_performance(_nlog(spark, d))


def _wait_counts(spark, d, transform=None):
    tr = transitions(_nlog(spark, d), region=REGION)
    return stats.value_counts(stats.wait_groups_long(tr), transform=transform)


def q_wait_summary(spark, d):
    return stats.quantile_summary(_wait_counts(spark, d), stats.group_dim(spark))


def q_box_stats(spark, d):
    logc = _wait_counts(spark, d, transform=lambda v: F.log(F.lit(1.0) + v))
    return stats.box_stats(logc, stats.group_dim(spark))


def q_wait_ecdf(spark, d):
    return stats.ecdf(_wait_counts(spark, d))


def q_calendar(spark, d):
    o = _t(spark, d, "orders")
    ts = F.col("o_orderdate")
    return o.select("o_orderkey", F.to_date(ts).alias("order_date"), F.year(ts).alias("year"),
                    F.hour(ts).alias("hour"), weekday_index(ts).alias("weekday"), day_name(ts).alias("day_name"),
                    year_week(ts).alias("year_week"), is_weekend(ts).alias("is_weekend"),
                    time_of_day(ts).alias("time_of_day"))


def q_day_type(spark, d):
    o = _t(spark, d, "orders")
    ts = F.col("o_orderdate")
    wk = is_weekend(ts)
    o = o.select("o_orderkey", "o_orderdate", is_holiday("o_orderdate", REGION).alias("is_holiday"))
    return o.select("o_orderkey", F.to_date(ts).alias("order_date"), "is_holiday",
                    wk.alias("is_weekend"), day_type(F.col("is_holiday"), wk).alias("day_type"))


def q_case_summary(spark, d):
    return features.case_summary(_log(spark, d))


def q_top_activities(spark, d):
    return features.top_activities(_log(spark, d), TOP_K)


def q_proc_matrix(spark, d):
    return features.proc_matrix(_log(spark, d), TOP_K)


def q_case_features(spark, d):
    return features.case_features(_log(spark, d), TOP_K)


def q_topk_rows(spark, d):
    return features.topk_rows(_log(spark, d), TOPK_ROWS_K)


def _sv(spark, d):
    return ops.service_view(_log(spark, d), region=None)


def q_filter_kpis(spark, d):
    return ops.kpi_cube(_sv(spark, d))


def q_weeks(spark, d):
    return ops.weeks(_sv(spark, d))


def q_daily_mean(spark, d):
    return ops.daily_mean(_sv(spark, d))


def q_hourly_mean(spark, d):
    return ops.hourly_mean(_sv(spark, d))


def q_heatmap(spark, d):
    return ops.heatmap(_sv(spark, d))


def q_slot_forecast(spark, d):
    return ops.slot_forecast(_sv(spark, d))


def q_mae(spark, d):
    sv = _sv(spark, d)
    return ops.mae_against(sv, ops.slot_forecast(sv))


def _durations(spark, d):
    log = _log(spark, d)
    return log.select("event_id", "start_ts", "end_ts", "activity",
                      minutes_between("start_ts", "end_ts").alias("duration_min"))


def q_duration_box(spark, d):
    """Box statistics of positive durations for each of the ten most frequent activities."""
    pos = _durations(spark, d).filter(F.col("duration_min") > 0)
    top = features.top_activity_list(pos, DURATION_BOX_K)          # ten names at most
    dim = spark.createDataFrame(list(zip(top, range(1, len(top) + 1))), "activity string, grp_no int")
    long = pos.filter(F.col("activity").isin(top)).select("activity", F.col("duration_min").alias("value"))
    return stats.box_stats(stats.value_counts(long, keys=("activity",)), dim, keys=("activity",))


def q_describe(spark, d):
    return stats.describe(_durations(spark, d), "duration_min")


def q_histogram(spark, d):
    pos = _durations(spark, d).filter(F.col("duration_min") > 0)
    return stats.histogram(pos, "duration_min", 50)


def _capped(spark, d):
    pos = _durations(spark, d).filter(F.col("duration_min") > 0)
    return stats.quantile_cap(pos, "duration_min", 0.99, "duration_capped")


def q_capped(spark, d):
    return _capped(spark, d).select("event_id", "duration_min", "duration_capped")


def q_longest(spark, d):
    return (_capped(spark, d).orderBy(F.col("duration_min").desc(), F.col("event_id").asc()).limit(5)
            .select("start_ts", "end_ts", "activity", "duration_min", "duration_capped"))


def q_normalise_activity(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", "p_name",
                    collapse_labels(normalise_text("p_name"), PART_RULES).alias("activity"))


def q_label_minutes(spark, d):
    ev = _t(spark, d, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ["s", "M", "h", "d", "w"]]),
                        (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))
    lab = F.concat(F.format_string("%.2f", F.col("value")), unit)
    return ev.select("event_id", lab.alias("label"), duration_label_to_minutes(lab).alias("label_minutes"))


def q_multi_hot(spark, d):
    log = _log(spark, d)
    vocab = features.top_activity_list(log, TOP_K)
    procs = log.groupBy("case_id").agg(
        F.array_union(F.collect_set("activity"), F.array(F.lit("unknown_procedure"))).alias("procedures"))
    return procs.select("case_id", *multi_hot("procedures", vocab))


def q_training_rows(spark, d):
    return modeling.training_rows(_log(spark, d)).select("event_id", "Waiting_Time_Mins", "Day_Index",
                                                          "Arrival_Hour")


def q_chrono_split(spark, d):
    cs = features.case_summary(_log(spark, d))
    return modeling.chrono_split_flag(cs, "encounter_start", VAL_FRACTION).select(
        "case_id", "encounter_start", "encounter_duration_minutes", "split")


def q_gbt_score(spark, d):
    rows = modeling.random_split_flag(modeling.training_rows(_log(spark, d)))
    tr, te = modeling.split_frames(rows, "train", "test")
    model = modeling.train_on_cells(tr, "Waiting_Time_Mins", modeling.CALENDAR_FEATURES)
    return modeling.score(model, te).select("event_id", "Waiting_Time_Mins", "predicted_min")


def q_feature_model(spark, d):
    feats = features.case_features(_log(spark, d), TOP_K)
    tr, va = modeling.split_frames(modeling.chrono_split_flag(feats, "encounter_start", VAL_FRACTION))
    model = modeling.train(tr, "encounter_duration_minutes")
    return modeling.score(model, va).select("case_id", "encounter_duration_minutes", "predicted_min")


# ------------------------------------------- the same operators on uneven data

CASE_SIZE_SPLIT = 67         # about half of the fixture's cases have fewer events
UNEVEN_K = 3
SPARSE_K = 10
SAMPLE_TEXTS = ["  Fetal Anatomy Study \t", "\nAssessment of ANXIETY  ", " Drug Abuse prevention", "RENAL DIALYSIS (procedure) ",
                "Combined Chemotherapy and Radiation", "  Echocardiography", "Plain chest X-Ray (procedure)",
                "Hepatitis C antibody TEST ", "  Walking Aid  Fitting "]


def q_case_sizes(spark, d):
    """Sizes of the cases that reach the threshold (the others are dropped from the log)."""
    return clean.case_sizes(clean.min_case_size(_log(spark, d), CASE_SIZE_SPLIT))


def _spans_log(spark, d):
    """Each event a case of its own; a third has no length and some end before they start."""
    end = (F.when(F.col("event_id") % 3 == 0, F.col("start_ts"))
           .when(F.col("event_id") % 5 == 0, F.timestamp_add("HOUR", F.lit(-2), F.col("start_ts"))).otherwise(F.col("end_ts")))
    return _log(spark, d).withColumns({"case_id": F.col("event_id"), "end_ts": end})


def q_case_summary_uneven(spark, d):
    return features.case_summary(_spans_log(spark, d))


def q_training_rows_uneven(spark, d):
    return modeling.training_rows(_spans_log(spark, d)).select("event_id", "Waiting_Time_Mins", "Day_Index", "Arrival_Hour")


def _brand_log(spark, d):
    """Order lines as a log: case = order, activity = brand of the part, padded."""
    li, pt = _t(spark, d, "lineitem"), _t(spark, d, "part")
    return li.join(pt, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("  "), F.col("p_brand"), F.lit("\t")).alias("activity"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("start_ts"),
        F.timestamp_add("MINUTE", F.col("l_linenumber").cast("int"), F.col("l_shipdate").cast("timestamp_ntz")).alias("end_ts"))


def _long_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c.startswith(features.PREFIX)]
    pairs = F.array(*[F.struct(F.lit(c.removeprefix(features.PREFIX)).alias("label"), F.col(f"`{c}`").alias("n")) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.label", "p.n")


def q_proc_matrix_top3(spark, d):
    """Counts of the three most frequent brands; orders without any of them are absent, other cells are 0."""
    return _long_counts(features.proc_matrix(_brand_log(spark, d), UNEVEN_K), ["case_id"])


def q_heavy_hitters(spark, d):
    """The most frequent of very many labels: pairs of part and supplier."""
    log = _t(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("activity"))
    return heavy.heavy_hitters(log, TOP_K)


def q_sparse_features(spark, d):
    """The counts of the ten most frequent brands of each order as a sparse vector, told as index:count."""
    log = _brand_log(spark, d)
    feats = sparse.sparse_case_features(log, sparse.activity_index(log, SPARSE_K))
    cell = F.transform(vector_to_array("features"), lambda n, i: F.when(n > 0, F.concat_ws(":", i, n.cast("int"))))
    return feats.select("case_id", "event_count", F.array_join(F.array_compact(cell), ",").alias("counts"))


def q_case_features_top3(spark, d):
    return _long_counts(features.case_features(_brand_log(spark, d), UNEVEN_K), ["case_id", "event_count"])


def q_multi_hot_top3(spark, d):
    log = features._trimmed(_brand_log(spark, d))
    lists = log.groupBy("case_id").agg(F.collect_set("activity").alias("procedures"))
    hot = lists.select("case_id", *multi_hot("procedures", features.top_activity_list(log, UNEVEN_K)))
    return _long_counts(hot, ["case_id"])


def _variant_log(spark, d):
    """Labels with dots and labels that differ only in case."""
    t, k = F.col("activity"), F.col("event_id") % 3
    return _log(spark, d).withColumn("activity", F.when(k == 0, F.upper(t)).when(k == 1, F.concat(t, F.lit(".x"))).otherwise(t))


def q_case_features_labels(spark, d):
    return features.case_features(_variant_log(spark, d), TOP_K)


def _night_weekday(spark, d):
    return ops.filter_view(_sv(spark, d), ops.TOD_NIGHT, ops.WEEK_ALL, "Weekday")


def q_daily_mean_filtered(spark, d):
    return ops.daily_mean(_night_weekday(spark, d))


def q_hourly_mean_filtered(spark, d):
    return ops.hourly_mean(_night_weekday(spark, d))


def q_heatmap_filtered(spark, d):
    return ops.heatmap(_night_weekday(spark, d))


def q_slot_forecast_filtered(spark, d):
    """Most slots are empty, so the fallback shows."""
    return ops.slot_forecast(_night_weekday(spark, d))


def q_collapse_clinical(spark, d):
    texts = F.array(*[F.lit(x) for x in SAMPLE_TEXTS])
    text = F.element_at(texts, (F.col("p_partkey") % len(SAMPLE_TEXTS) + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", collapse_labels(normalise_text(text)).alias("activity"))


def q_collapse_distinct(spark, d):
    """The clinical rules on every text, computed once per distinct text."""
    texts = F.array(*[F.lit(x) for x in SAMPLE_TEXTS])
    text = F.element_at(texts, (F.col("p_partkey") % len(SAMPLE_TEXTS) + 1).cast("int"))
    return clean.relabel_distinct(_t(spark, d, "part").select("p_partkey", text.alias("activity")), lambda c: collapse_labels(normalise_text(c)))


def q_calendar_hours(spark, d):
    o = _t(spark, d, "orders").withColumn("o_at", F.timestamp_add(
        "MINUTE", (F.col("o_orderkey") * 7919 % 1440).cast("int"), F.col("o_orderdate")))
    ts = F.col("o_at")
    return o.select("o_orderkey", "o_at", F.hour(ts).cast("int").alias("hour"), time_of_day(ts).alias("time_of_day"),
                    year_week(ts).alias("year_week"), is_weekend(ts).alias("is_weekend"))


def _quoted_log(spark, d):
    """Quoted labels, and events of a case that start in the same minute, so that only the id orders them."""
    return _log(spark, d).withColumns({
        "activity": F.concat(F.lit('say "'), F.col("activity"), F.lit('"; done, next')),
        "start_ts": F.date_trunc("MONTH", F.col("start_ts").cast("timestamp")).cast("timestamp_ntz"),
        "end_ts": F.date_trunc("MONTH", F.col("start_ts").cast("timestamp")).cast("timestamp_ntz"),
        "event_ts": F.date_trunc("MONTH", F.col("start_ts").cast("timestamp")).cast("timestamp_ntz")})


def q_csv_roundtrip(spark, d):
    """Edges of a log that was written as CSV and read back."""
    path = write_log(_quoted_log(spark, d), shared_path(spark, f"roundtrip-{uuid.uuid4().hex}"), fmt="csv")
    return dfg.dfg_edges(read_log(spark, path, fmt="csv", ntz=True))


def q_random_split(spark, d):
    return modeling.random_split_flag(modeling.training_rows(_log(spark, d))).select("event_id", "split")


def q_gbt_mae(spark, d):
    """Test rows, and whether the trees' error is within a tenth of that of the training mean."""
    rows = modeling.random_split_flag(modeling.training_rows(_log(spark, d)))
    tr, te = modeling.split_frames(rows, "train", "test")
    model = modeling.train_on_cells(tr, "Waiting_Time_Mins", modeling.CALENDAR_FEATURES)
    mean = tr.agg(F.avg("Waiting_Time_Mins").alias("m"))
    err = model.transform(te).crossJoin(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("Waiting_Time_Mins") - F.col("prediction"))).alias("e"),
        F.avg(F.abs(F.col("Waiting_Time_Mins") - F.col("m"))).alias("b"))
    return err.select("n", (F.col("e") <= 1.1 * F.col("b")).alias("in_band"))


def q_predict_procs(spark, d):
    """Lists of procedures -> vector -> model -> minutes: one finite prediction for every case."""
    log = _log(spark, d)
    feats = features.case_features(log, names=VOCAB)
    model = modeling.train(feats, "encounter_duration_minutes")
    lists = log.groupBy("case_id").agg(F.collect_set("activity").alias("procedures"))
    out = modeling.predict_minutes(model, lists, VOCAB, keep=("case_id",))
    minutes = F.col("predicted_min")
    return out.select("case_id", (minutes.isNotNull() & ~F.isnan(minutes) & (minutes > 0)).alias("finite"))


# One tree of one split, so that SQL can find the same model.
STUMP_PARAMS = dict(maxIter=1, stepSize=0.1, maxDepth=1, seed=42)


def q_stump_calendar(spark, d):
    """The best single split of (weekday, hour) for service minutes, and the minutes predicted for each cell."""
    rows = modeling.training_rows(_log(spark, d))
    model = modeling.train_on_cells(rows, "Waiting_Time_Mins", modeling.CALENDAR_FEATURES, STUMP_PARAMS)
    feature, threshold = modeling.first_split(model, modeling.CALENDAR_FEATURES) or (None, None)
    grid = modeling.cells(rows, "Waiting_Time_Mins", modeling.CALENDAR_FEATURES)
    return modeling.score(model, grid).select("Day_Index", "Arrival_Hour", F.col("rows").cast("bigint").alias("n"), "predicted_min",
                                              F.lit(feature).alias("split_feature"), F.lit(threshold).cast("double").alias("threshold"))


def _visits_log(spark, d):
    """One case for each user and day, so that few cases have all activities."""
    return _log(spark, d).withColumn("case_id", F.col("case_id") * 1000 + F.dayofyear("start_ts"))


def q_stump_procs(spark, d):
    """Lists of procedures -> 0/1 vector -> one-split model of the visits' duration -> minutes."""
    log = _visits_log(spark, d)
    lists = log.groupBy("case_id").agg(F.collect_set("activity").alias("procedures"))
    names = [name for _, name in features.count_columns(VOCAB)]
    vectors = lists.select("case_id", *multi_hot("procedures", VOCAB))
    minutes = features.case_summary(log).select("case_id", "encounter_duration_minutes")
    model = modeling.train_on_cells(vectors.join(minutes, "case_id"), "encounter_duration_minutes", names, STUMP_PARAMS)
    return modeling.predict_minutes(model, lists, VOCAB, keep=("case_id",))


def _scratch(spark, name):
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def _raw_file(spark, d, newest_first=False):
    """The raw log as a ``;`` file whose header has spaces around the names and a column that nobody reads."""
    raw = _raw_text(spark, d)
    if newest_first:
        raw = raw.repartitionByRange(F.col("event_id").desc()).sortWithinPartitions(F.col("event_id").desc())
    raw = raw.select(F.col("ENCOUNTER").alias(" ENCOUNTER"), F.lit("x").alias("COST "), F.col("START").alias("START "),
                     F.col("STOP").alias(" STOP "), F.col("DESCRIPTION").alias("DESCRIPTION"))
    path = _scratch(spark, "raw")
    csv_options(raw.write.option("sep", ";")).csv(path)
    return path


def q_raw_ingest(spark, d):
    """A raw file with padded headers, read and cleaned."""
    return ingest_log(spark, _raw_file(spark, d), ntz=True).drop("event_id")


def q_raw_first_cases(spark, d):
    """The first cases by their place in the raw file, which begins with the newest event."""
    return ingest_log(spark, _raw_file(spark, d, newest_first=True), ntz=True, n_cases=20).drop("event_id")


def q_strict_log(spark, d):
    """A log written as CSV and read back with strict timestamps."""
    path = write_log(_log(spark, d), _scratch(spark, "log"), fmt="csv")
    return read_log(spark, path, fmt="csv", ntz=True, strict=True).withColumn("case_id", F.col("case_id").cast("bigint"))


def q_dated_days_off(spark, d):
    """The events of holidays and weekends of a log in folders by date; only folders of such dates are read."""
    path = write_dated_log(_log(spark, d), _scratch(spark, "dated"))
    return read_dated_log(spark, path, day_types=["Holiday", "Weekend"])


def q_bucketed_transitions(spark, d):
    """The transitions of a log in buckets by case; its windows need no exchange."""
    log, sizes, _ = read_bucketed_log(spark, write_bucketed_log(_nlog(spark, d), _scratch(spark, "bucketed")))
    return transitions(log, region=REGION, sizes=sizes)


def q_transition_report(spark, d):
    """The text of the transition report, as a reader of the file sees it."""
    path = write_transitions(transitions(_nlog(spark, d), region=REGION), _scratch(spark, "report"))
    text = csv_options(spark.read).csv(path)
    return text.select(*[F.col(f"`{c}`").alias(c.replace(":", "_")) for c in (
        "case:concept:name", "concept:name", "next_activity", "start:timestamp", "next_start", "date", "is_holiday", "is_weekend", "day_type")])


def q_feature_store(spark, d):
    """Log -> written features -> features read from the store."""
    log = write_log(_log(spark, d), _scratch(spark, "log"))
    store = _scratch(spark, "store")
    build_features(spark, log, store, fmt="parquet", top_k=TOP_K)
    return read_features(spark, store)


def q_model_store(spark, d):
    """A model and its error, saved and loaded: predictions of the loaded model, and the error that was saved."""
    rows = modeling.training_rows(_log(spark, d))
    model = modeling.train_on_cells(rows, "Waiting_Time_Mins", modeling.CALENDAR_FEATURES, STUMP_PARAMS)
    paths = modeling.save_artifacts(_scratch(spark, "models"), model, modeling.evaluate(model, rows, "Waiting_Time_Mins"))
    loaded = modeling.load_model(paths["model"].rsplit("/", 1)[0])
    saved = spark.read.json(paths["metrics"]).select(F.round("mae", 6).alias("mae"))
    grid = modeling.cells(rows, "Waiting_Time_Mins", modeling.CALENDAR_FEATURES)
    return modeling.score(loaded, grid).select("Day_Index", "Arrival_Hour", "predicted_min").crossJoin(F.broadcast(saved))


HOUR_LIMIT = 50.0      # minutes; some hours of the test tables are over it, others are not


def q_hourly_mean_limit(spark, d):
    """The hourly chart with a limit that some hours pass."""
    return ops.hourly_mean(ops.service_view(_log(spark, d)), limit=HOUR_LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the transition table (successor window + gaps + calendar labels) on sf0.001."""
    return q_transitions(spark, SMOKE_DIR)


def _corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and oracles of the corpus operators and their pipeline, if they are installed."""
    try:
        import corpus_pipeline
        from pathweave.llm import queries as corpus
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "pathweave.llm"):
            raise
        return {}, {}
    runs = {**corpus.queries(), "pipeline": corpus_pipeline.run}
    sql = {**corpus.oracle_sql(), **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
    return runs, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **_corpus()[0]}


# ------------------------------------------------------------ oracle SQL

LOG = """log AS (
  SELECT user_id AS case_id, event_type AS activity, ts AS start_ts,
         ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS end_ts,
         ts AS event_ts, event_id
  FROM events)"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _collapse_sql(x: str, rules) -> str:
    arms = " ".join(f"WHEN regexp_matches({x}, {_sql_str(r)}) OR contains({x}, {_sql_str(lab)}) "
                    f"THEN {_sql_str(lab)}" for r, lab in rules)
    return f"(CASE {arms} ELSE {x} END)"


def _norm_sql(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


# No rule fires on the fixture's activities; q_collapse_clinical hits every rule.
NLOG = LOG + f""",
nlog AS (
  SELECT case_id, {_norm_sql('activity')} AS activity,
         start_ts, end_ts, event_ts, event_id
  FROM log)"""


# Federal holidays, written out for the oracle: (month, day, first year) and (month, ISO weekday, first day, last day).
_ORACLE_FIXED = [(1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)]
_ORACLE_NTH = [(1, 1, 15, 21), (2, 1, 15, 21), (5, 1, 25, 31), (9, 1, 1, 7), (10, 1, 8, 14), (11, 4, 22, 28)]
_ORACLE_REGION = {"MA": [(4, 1, 15, 21)]}


def _holiday_sql(ts: str, region: str | None) -> str:
    d = f"CAST({ts} AS DATE)"
    parts = []
    for m, day, since in _ORACLE_FIXED:
        for shift, only in (("", ""), (" + INTERVAL 1 DAY", f"isodow({d}) = 5 AND "), (" - INTERVAL 1 DAY", f"isodow({d}) = 1 AND ")):
            x = f"({d}{shift})"
            parts.append(f"{only}month({x}) = {m} AND day({x}) = {day} AND year({x}) >= {since}")
    for m, wd, lo, hi in _ORACLE_NTH + _ORACLE_REGION.get(region or "", []):
        parts.append(f"month({d}) = {m} AND isodow({d}) = {wd} AND day({d}) BETWEEN {lo} AND {hi}")
    return "(" + " OR ".join(f"({p})" for p in parts) + ")"


def _round2(x: str) -> str:
    return f"(round_even(({x}) * 100.0, 0) / 100.0)"


def _round_exact_sql(x: str, digits: int = 2) -> str:
    """Python ``round(x, 2)``: half-even on the exact binary value (Dekker product split)."""
    sc = float(10 ** digits)
    sp = 134217729.0
    bh = (sp * sc) - ((sp * sc) - sc)
    bl = sc - bh
    p = f"(({x}) * {sc})"
    c = f"({sp} * ({x}))"
    ah = f"({c} - ({c} - ({x})))"
    al = f"(({x}) - {ah})"
    e = f"((({ah} * {bh} - {p}) + {ah} * {bl} + {al} * {bh}) + {al} * {bl})"
    tie = f"({p} - floor({p}) = 0.5)"
    return (f"(CASE WHEN {tie} AND {e} > 0 THEN floor({p}) + 1 WHEN {tie} AND {e} < 0 THEN floor({p}) "
            f"ELSE round_even({p}, 0) END / {sc})")


def _minutes(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 1e6 / 60.0)"


def _npq(values: str, p: float) -> str:
    """numpy's default quantile of an ordered list."""
    pos = f"((len({values}) - 1) * CAST({p!r} AS DOUBLE))"
    a, b = f"{values}[CAST(floor({pos}) AS BIGINT) + 1]", f"{values}[CAST(ceil({pos}) AS BIGINT) + 1]"
    t = f"({pos} - floor({pos}))"
    return f"(CASE WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1.0 - {t}) ELSE {a} + ({b} - {a}) * {t} END)"


SUCC = NLOG + """,
succ AS (
  SELECT *, lead(start_ts) OVER w AS next_start, lead(activity) OVER w AS next_activity
  FROM nlog WINDOW w AS (PARTITION BY case_id ORDER BY start_ts, end_ts, event_id))"""

TRANS = SUCC + f""",
t0 AS (
  SELECT *, {_round2(_minutes('end_ts', 'next_start'))} AS raw_gap_min
  FROM succ WHERE next_activity IS NOT NULL),
trans AS (
  SELECT case_id, activity, next_activity, start_ts, end_ts, next_start, raw_gap_min,
         {_round2('CASE WHEN raw_gap_min < 0 THEN 0.0 ELSE raw_gap_min END')} AS waiting_min,
         CAST(start_ts AS DATE) AS start_date,
         {_holiday_sql('start_ts', REGION)} AS is_holiday,
         isodow(start_ts) >= 6 AS is_weekend,
         CASE WHEN {_holiday_sql('start_ts', REGION)} THEN 'holiday'
              WHEN isodow(start_ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type
  FROM t0)"""

GROUPS_VALUES = ", ".join(f"({_sql_str(dm)}, {_sql_str(g)}, {i})" for i, (dm, g) in enumerate(stats.WAIT_GROUPS))

LONG = TRANS + f""",
dim(dimension, grp, grp_no) AS (VALUES {GROUPS_VALUES}),
long AS (
  SELECT 'time_of_day' AS dimension,
         CASE WHEN hour(start_ts) >= 6 AND hour(start_ts) < 18 THEN 'day' ELSE 'night' END AS grp,
         waiting_min AS value FROM trans
  UNION ALL
  SELECT 'weekend', CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END, waiting_min FROM trans
  UNION ALL
  SELECT 'day_type', day_type, waiting_min FROM trans),
pos AS (SELECT * FROM long WHERE value > 0)"""

SV = LOG + f""",
sv AS (
  SELECT *, CASE WHEN {_minutes('start_ts', 'end_ts')} < 0 THEN 0.0 ELSE {_minutes('start_ts', 'end_ts')} END
              AS service_min,
         CAST(hour(start_ts) AS INTEGER) AS arrival_hour, strftime(start_ts, '%A') AS day_name,
         CAST(isodow(start_ts) - 1 AS INTEGER) AS day_no,
         strftime(start_ts, '%Y - Week %U') AS year_week,
         CASE WHEN {_holiday_sql('start_ts', None)} THEN 'Holiday'
              WHEN isodow(start_ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type
  FROM log),
days(day_no, day_name) AS (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                                  (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday'))"""

DUR = LOG + f""",
dur AS (SELECT event_id, start_ts, end_ts, activity, {_minutes('start_ts', 'end_ts')} AS duration_min FROM log),
posd AS (SELECT * FROM dur WHERE duration_min > 0),
cap AS (SELECT {_npq('v', 0.99)} AS q FROM (SELECT list(duration_min ORDER BY duration_min) AS v FROM posd)),
capped AS (SELECT posd.*, least(duration_min, q) AS duration_capped FROM posd, cap)"""

_PCOUNTS = ", ".join(f"count(*) FILTER (WHERE activity = '{v}') AS proc_count__{v}" for v in VOCAB)

SUMMARY = LOG + f""",
summ AS (
  SELECT case_id, min(start_ts) AS encounter_start, max(end_ts) AS encounter_end,
         count(activity) AS event_count,
         {_minutes('min(start_ts)', 'max(end_ts)')} AS encounter_duration_minutes
  FROM log GROUP BY case_id)"""

_HIST = f"""
mm AS (SELECT min(duration_min) AS mn, max(duration_min) AS mx FROM posd),
b0 AS (
  SELECT p.duration_min AS v, mm.mn, mm.mx, (mm.mx - mm.mn) / 50.0 AS step,
         CASE WHEN mm.mx = mm.mn THEN 0
              ELSE least(CAST(floor((p.duration_min - mm.mn) * (50.0 / (mm.mx - mm.mn))) AS INTEGER), 49) END AS b
  FROM posd p, mm),
b1 AS (
  SELECT v, mn, mx, step,
         CASE WHEN mx <> mn AND v < (CASE WHEN b >= 50 THEN mx ELSE b * step + mn END) THEN b - 1 ELSE b END AS b
  FROM b0),
b2 AS (
  SELECT CASE WHEN mx <> mn AND b <> 49 AND v >= (CASE WHEN b + 1 >= 50 THEN mx ELSE (b + 1) * step + mn END)
              THEN b + 1 ELSE b END AS b
  FROM b1),
cnt AS (SELECT b, count(*) AS n FROM b2 GROUP BY b)
SELECT g.bin,
       CASE WHEN g.bin >= 50 THEN mm.mx ELSE g.bin * ((mm.mx - mm.mn) / 50.0) + mm.mn END AS lo,
       CASE WHEN g.bin + 1 >= 50 THEN mm.mx ELSE (g.bin + 1) * ((mm.mx - mm.mn) / 50.0) + mm.mn END AS hi,
       coalesce(cnt.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) g CROSS JOIN mm LEFT JOIN cnt ON cnt.b = g.bin
ORDER BY g.bin"""


def _label_sql() -> str:
    lab = ("printf('%.2f', value) || (['s', 'M', 'h', 'd', 'w'])[CAST(event_id % 5 AS INTEGER) + 1]")
    rx = "'^(\\d+(?:\\.\\d+)?)\\s*([smhdSMHD])$'"
    val = f"CAST(regexp_extract(label, {rx}, 1) AS DOUBLE)"
    unit = f"lower(regexp_extract(label, {rx}, 2))"
    mins = (f"CASE {unit} WHEN 's' THEN {val} / 60.0 WHEN 'm' THEN {val} WHEN 'h' THEN {val} * 60.0 "
            f"WHEN 'd' THEN {val} * 1440.0 END")
    return f"""
WITH l AS (SELECT event_id, {lab} AS label FROM events)
SELECT event_id, label,
       CASE WHEN regexp_matches(label, {rx}) THEN printf('%.2f min', {_round_exact_sql(mins)}) ELSE label END
         AS label_minutes
FROM l"""


def oracle_sql() -> dict[str, str]:
    return {**_log_oracles(), **_corpus()[1]}


def _log_oracles() -> dict[str, str]:
    q = {}
    q["q_load_log"] = f"WITH {LOG} SELECT * FROM log"
    q["q_case_sizes"] = f"""
WITH {LOG} SELECT case_id, count(*) AS n_events FROM log GROUP BY case_id HAVING count(*) >= {CASE_SIZE_SPLIT}"""
    spans = f"""
WITH {LOG},
spans AS (
  SELECT event_id AS case_id, event_id, start_ts,
         CASE WHEN event_id % 3 = 0 THEN start_ts WHEN event_id % 5 = 0 THEN start_ts - INTERVAL 2 HOUR ELSE end_ts END AS end_ts
  FROM log)"""
    q["q_case_summary_uneven"] = spans + f"""
SELECT case_id, start_ts AS encounter_start, end_ts AS encounter_end, CAST(1 AS BIGINT) AS event_count,
       {_minutes('start_ts', 'end_ts')} AS encounter_duration_minutes, {_minutes('start_ts', 'end_ts')} / 60.0 AS total_hours
FROM spans WHERE end_ts > start_ts"""
    q["q_training_rows_uneven"] = spans + f"""
SELECT event_id, {_minutes('start_ts', 'end_ts')} AS Waiting_Time_Mins, CAST(isodow(start_ts) - 1 AS INTEGER) AS Day_Index,
       CAST(hour(start_ts) AS INTEGER) AS Arrival_Hour
FROM spans WHERE end_ts >= start_ts"""
    brands = f"""
WITH lines AS (SELECT l_orderkey AS case_id, p_brand AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
top AS (SELECT label FROM lines GROUP BY label ORDER BY count(*) DESC, label LIMIT {UNEVEN_K}),
cells AS (
  SELECT c.case_id, c.event_count, top.label, count(l.label) AS n
  FROM (SELECT case_id, count(*) AS event_count FROM lines GROUP BY case_id) c CROSS JOIN top
  LEFT JOIN lines l ON l.case_id = c.case_id AND l.label = top.label GROUP BY 1, 2, 3)"""
    q["q_proc_matrix_top3"] = brands + """
SELECT case_id, label, n FROM cells WHERE case_id IN (SELECT case_id FROM cells WHERE n > 0)"""
    q["q_case_features_top3"] = brands + "\nSELECT case_id, event_count, label, n FROM cells"
    q["q_sparse_features"] = brands + f""",
ten AS (SELECT label FROM lines GROUP BY label ORDER BY count(*) DESC, label LIMIT {SPARSE_K}),
places AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM ten),
counts AS (SELECT case_id, i, count(*) AS n FROM lines JOIN places USING (label) GROUP BY 1, 2),
told AS (SELECT case_id, string_agg(i || ':' || n, ',' ORDER BY i) AS counts FROM counts GROUP BY 1)
SELECT c.case_id, c.event_count, coalesce(told.counts, '') AS counts
FROM (SELECT case_id, count(*) AS event_count FROM lines GROUP BY case_id) c LEFT JOIN told USING (case_id)"""
    q["q_heavy_hitters"] = f"""
SELECT l_partkey || '-' || l_suppkey AS activity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, activity LIMIT {TOP_K}"""
    q["q_multi_hot_top3"] = brands + "\nSELECT case_id, label, CAST(n > 0 AS INTEGER) AS n FROM cells"
    # Sorted labels: capitals come first; what equals an earlier label but for case, or has a dot, ends in a checksum.
    named = [(v.upper(), v.upper()) for v in VOCAB]
    named += [(v, f"{v}__{zlib.crc32(v.encode()):08x}") for v in VOCAB]
    named += [(f"{v}.x", f"{v}_x__{zlib.crc32(f'{v}.x'.encode()):08x}") for v in VOCAB]
    cells = ", ".join(f"count(*) FILTER (WHERE label = '{v}') AS proc_count__{c}" for v, c in named)
    q["q_case_features_labels"] = f"""
WITH {LOG},
v AS (SELECT *, CASE event_id % 3 WHEN 0 THEN upper(activity) WHEN 1 THEN activity || '.x' ELSE activity END AS label FROM log),
f AS (
  SELECT case_id, min(start_ts) AS encounter_start, max(end_ts) AS encounter_end, count(*) AS event_count, {cells}
  FROM v GROUP BY case_id)
SELECT *, {_minutes('encounter_start', 'encounter_end')} AS encounter_duration_minutes,
       {_minutes('encounter_start', 'encounter_end')} / 60.0 AS total_hours
FROM f WHERE encounter_end > encounter_start"""
    labels = ["pregnancy & fetal care", "mental/behavioral health", "substance/abuse screening", "renal/dialysis", "oncology therapy",
              "cardiology procedures/tests", "imaging tests", "lab tests / std panel", "walking aid  fitting"]
    arms = " ".join(f"WHEN {i} THEN {_sql_str(x)}" for i, x in enumerate(labels))
    q["q_collapse_clinical"] = f"SELECT p_partkey, CASE p_partkey % {len(labels)} {arms} END AS activity FROM part"
    q["q_collapse_distinct"] = q["q_collapse_clinical"]
    q["q_calendar_hours"] = """
WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey * 7919 % 1440 AS INTEGER)) AS o_at FROM orders)
SELECT o_orderkey, o_at, CAST(hour(o_at) AS INTEGER) AS hour, CASE WHEN hour(o_at) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS time_of_day,
       strftime(o_at, '%Y - Week %U') AS year_week, isodow(o_at) >= 6 AS is_weekend
FROM o"""
    q["q_csv_roundtrip"] = f"""
WITH {LOG},
t AS (SELECT case_id, 'say "' || activity || '"; done, next' AS activity, date_trunc('month', start_ts) AS start_ts, event_id FROM log),
s AS (SELECT activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY start_ts, event_id) AS dst FROM t)
SELECT src, dst, count(*) AS n FROM s WHERE dst IS NOT NULL GROUP BY 1, 2"""
    bucket = "CAST('0x' || substr(md5('42:' || event_id), 1, 10) AS BIGINT) % 1000000"
    split = f"""
WITH {LOG},
r AS (SELECT event_id, {_minutes('start_ts', 'end_ts')} AS w FROM log WHERE end_ts >= start_ts),
p AS (SELECT event_id, w, CASE WHEN {bucket} < 800000 THEN 'train' ELSE 'test' END AS split FROM r)"""
    q["q_random_split"] = split + "\nSELECT event_id, split FROM p"
    # The trees see (weekday, hour) only, so the training mean of each such cell stands in for them.
    q["q_gbt_mae"] = f"""
WITH {LOG},
r AS (SELECT event_id, {_minutes('start_ts', 'end_ts')} AS w, isodow(start_ts) AS d, hour(start_ts) AS h FROM log WHERE end_ts >= start_ts),
p AS (SELECT *, {bucket} < 800000 AS train FROM r),
c AS (SELECT d, h, avg(w) AS m FROM p WHERE train GROUP BY 1, 2)
SELECT count(*) AS n, avg(abs(w - c.m)) <= 1.1 * avg(abs(w - a.m)) AS in_band
FROM p JOIN c USING (d, h), (SELECT avg(w) AS m FROM p WHERE train) a WHERE NOT train"""
    # The best split leaves the least squared error: the greatest sum of n * mean * mean over its two sides.
    q["q_stump_calendar"] = f"""
WITH {LOG},
r AS (SELECT {_minutes('start_ts', 'end_ts')} AS w, CAST(isodow(start_ts) - 1 AS INTEGER) AS d, CAST(hour(start_ts) AS INTEGER) AS h
      FROM log WHERE end_ts >= start_ts),
v AS (SELECT 'Day_Index' AS f, d AS x, w FROM r UNION ALL SELECT 'Arrival_Hour', h, w FROM r),
x AS (SELECT f, x, (x + lead(x) OVER (PARTITION BY f ORDER BY x)) / 2.0 AS t FROM (SELECT DISTINCT f, x FROM v)),
s AS (SELECT x.f, x.t, avg(w) FILTER (WHERE v.x <= x.t) AS low, avg(w) FILTER (WHERE v.x > x.t) AS high,
             count(*) FILTER (WHERE v.x <= x.t) AS n_low, count(*) FILTER (WHERE v.x > x.t) AS n_high
      FROM x JOIN v ON v.f = x.f WHERE x.t IS NOT NULL GROUP BY x.f, x.t),
best AS (SELECT * FROM s ORDER BY n_low * low * low + n_high * high * high DESC LIMIT 1)
SELECT d AS Day_Index, h AS Arrival_Hour, count(*) AS n,
       round_even(any_value(CASE WHEN (CASE f WHEN 'Day_Index' THEN d ELSE h END) <= t THEN low ELSE high END), 2) AS predicted_min,
       any_value(f) AS split_feature, CAST(any_value(t) AS DOUBLE) AS threshold
FROM r, best GROUP BY d, h"""
    q["q_stump_procs"] = f"""
WITH {LOG},
visits AS (SELECT case_id * 1000 + dayofyear(start_ts) AS case_id, activity, start_ts, end_ts FROM log),
c AS (SELECT case_id, {_minutes('min(start_ts)', 'max(end_ts)')} AS w, list(DISTINCT activity) AS a FROM visits GROUP BY case_id),
v AS (SELECT f, list_contains(a, f) AS has, w FROM c, (SELECT unnest([{", ".join(_sql_str(v) for v in VOCAB)}]) AS f) WHERE w > 0),
s AS (SELECT f, avg(w) FILTER (WHERE NOT has) AS low, avg(w) FILTER (WHERE has) AS high,
             count(*) FILTER (WHERE NOT has) AS n_low, count(*) FILTER (WHERE has) AS n_high
      FROM v GROUP BY f),
best AS (SELECT * FROM s ORDER BY n_low * low * low + n_high * high * high DESC LIMIT 1)
SELECT case_id, round_even(CASE WHEN list_contains(a, f) THEN high ELSE low END, 2) AS predicted_min FROM c, best"""
    q["q_hourly_mean_limit"] = f"""
WITH {LOG}
SELECT CAST(hour(start_ts) AS INTEGER) AS arrival_hour, avg({_minutes('start_ts', 'end_ts')}) AS avg_wait_min,
       avg({_minutes('start_ts', 'end_ts')}) > {HOUR_LIMIT} AS above_limit
FROM log WHERE end_ts >= start_ts GROUP BY 1"""
    q["q_predict_procs"] = f"WITH {LOG} SELECT case_id, TRUE AS finite FROM log GROUP BY case_id"
    q["q_clean_log"] = f"""
WITH raw AS (
  SELECT CAST(user_id AS VARCHAR) AS ENCOUNTER,
         CASE WHEN event_type = 'error' AND value > 300 THEN 'n/a' ELSE CAST(ts AS VARCHAR) END AS START,
         CASE WHEN event_type = 'purchase' AND value > 300 THEN '2024-02-30 10:00:00'
              ELSE CAST(ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS VARCHAR) END AS STOP,
         NULLIF(event_type, 'signup') AS DESCRIPTION, event_id
  FROM events)
SELECT ENCOUNTER AS case_id, coalesce(DESCRIPTION, 'UNKNOWN_ACTIVITY') AS activity,
       TRY_CAST(START AS TIMESTAMP) AS start_ts, TRY_CAST(STOP AS TIMESTAMP) AS end_ts,
       TRY_CAST(START AS TIMESTAMP) AS event_ts, event_id
FROM raw
WHERE ENCOUNTER IS NOT NULL AND TRY_CAST(START AS TIMESTAMP) IS NOT NULL AND TRY_CAST(STOP AS TIMESTAMP) IS NOT NULL"""
    q["q_first_n_cases"] = f"""
WITH {LOG},
firsts AS (SELECT case_id, start_ts, event_id,
                  row_number() OVER (PARTITION BY case_id ORDER BY start_ts, event_id) AS rn FROM log),
cohort AS (SELECT case_id FROM firsts WHERE rn = 1 ORDER BY start_ts, event_id, case_id LIMIT {COHORT_N})
SELECT * FROM log WHERE case_id IN (SELECT case_id FROM cohort)"""
    q["q_min_case_size"] = f"""
WITH {LOG}
SELECT * FROM log WHERE case_id IN (SELECT case_id FROM log GROUP BY case_id HAVING count(*) >= {MIN_EVENTS})"""
    q["q_transitions"] = f"WITH {TRANS} SELECT * FROM trans"
    q["q_dfg_edges"] = f"""
WITH {SUCC}
SELECT activity AS src, next_activity AS dst, count(*) AS n FROM succ
WHERE next_activity IS NOT NULL GROUP BY 1, 2"""
    ends = f"""
WITH {NLOG},
r AS (SELECT case_id, activity,
             row_number() OVER (PARTITION BY case_id ORDER BY start_ts, end_ts, event_id) AS rn_first,
             row_number() OVER (PARTITION BY case_id ORDER BY start_ts DESC, end_ts DESC, event_id DESC) AS rn_last,
             count(*) OVER (PARTITION BY case_id) AS n_events
      FROM nlog)"""
    q["q_dfg_starts"] = ends + f"""
SELECT activity, count(*) AS n FROM r WHERE rn_first = 1 AND n_events >= {MIN_EVENTS} GROUP BY activity"""
    q["q_dfg_ends"] = ends + f"""
SELECT activity, count(*) AS n FROM r WHERE rn_last = 1 AND n_events >= {MIN_EVENTS} GROUP BY activity"""
    q["q_dfg_performance"] = f"""
WITH {SUCC},
g AS (SELECT activity AS src, next_activity AS dst, count(*) AS n,
             avg(date_diff('microsecond', start_ts, next_start) / 1e6) AS mean_seconds
      FROM succ WHERE next_activity IS NOT NULL GROUP BY 1, 2)
SELECT src, dst, n, mean_seconds, mean_seconds / 60.0 AS mean_minutes,
       printf('%.2f min', {_round_exact_sql('mean_seconds / 60.0')}) AS label
FROM g"""
    q["q_wait_summary"] = f"""
WITH {LONG},
lists AS (SELECT dimension, grp, list(value ORDER BY value) AS v FROM pos GROUP BY 1, 2),
agg AS (SELECT dimension, grp, len(v) AS n, {_npq('v', 0.5)} AS q50, {_npq('v', 0.9)} AS q90,
               {_npq('v', 0.95)} AS q95, {_npq('v', 0.99)} AS q99
        FROM lists)
SELECT dim.dimension, dim.grp, coalesce(agg.n, 0) AS n,
       {_round_exact_sql('q50')} AS median, {_round_exact_sql('q90')} AS p90, {_round_exact_sql('q95')} AS p95,
       {_round_exact_sql('q99')} AS p99
FROM dim LEFT JOIN agg USING (dimension, grp) ORDER BY grp_no"""
    q["q_box_stats"] = f"""
WITH {LONG},
lv AS (SELECT dimension, grp, ln(1.0 + value) AS value FROM pos),
lists AS (SELECT dimension, grp, avg(value) AS mean, list(value ORDER BY value) AS v FROM lv GROUP BY 1, 2),
q AS (SELECT dimension, grp, len(v) AS n, mean, {_npq('v', 0.25)} AS q1, {_npq('v', 0.5)} AS median, {_npq('v', 0.75)} AS q3
      FROM lists),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q),
w AS (SELECT lv.dimension, lv.grp,
             min(CASE WHEN value >= lo_f AND value <= hi_f THEN value END) AS whisker_lo,
             max(CASE WHEN value >= lo_f AND value <= hi_f THEN value END) AS whisker_hi,
             CAST(sum(CASE WHEN value >= lo_f AND value <= hi_f THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
      FROM lv JOIN f USING (dimension, grp) GROUP BY 1, 2)
SELECT dim.dimension, dim.grp, coalesce(f.n, 0) AS n, f.mean, f.q1, f.median, f.q3, f.iqr,
       w.whisker_lo, w.whisker_hi, coalesce(w.n_outliers, 0) AS n_outliers
FROM dim LEFT JOIN f USING (dimension, grp) LEFT JOIN w USING (dimension, grp) ORDER BY grp_no"""
    q["q_wait_ecdf"] = f"""
WITH {LONG},
c AS (SELECT dimension, grp, value, count(*) AS cnt FROM pos GROUP BY 1, 2, 3)
SELECT dimension, grp, value, cnt,
       CAST(sum(cnt) OVER (PARTITION BY dimension, grp ORDER BY value ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_le,
       CAST(sum(cnt) OVER (PARTITION BY dimension, grp) AS BIGINT) AS n,
       sum(cnt) OVER (PARTITION BY dimension, grp ORDER BY value ROWS UNBOUNDED PRECEDING)
         / sum(cnt) OVER (PARTITION BY dimension, grp) AS y
FROM c"""
    q["q_calendar"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, strftime(o_orderdate, '%A') AS day_name,
       strftime(o_orderdate, '%Y - Week %U') AS year_week, isodow(o_orderdate) >= 6 AS is_weekend,
       CASE WHEN hour(o_orderdate) >= 6 AND hour(o_orderdate) < 18 THEN 'day' ELSE 'night' END AS time_of_day
FROM orders"""
    hol = _holiday_sql("o_orderdate", REGION)
    q["q_day_type"] = f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, {hol} AS is_holiday,
       isodow(o_orderdate) >= 6 AS is_weekend,
       CASE WHEN {hol} THEN 'holiday' WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type
FROM orders"""
    q["q_case_summary"] = f"""
WITH {SUMMARY}
SELECT *, encounter_duration_minutes / 60.0 AS total_hours FROM summ WHERE encounter_duration_minutes > 0"""
    q["q_top_activities"] = f"""
WITH {LOG}
SELECT activity, count(*) AS n FROM log GROUP BY activity ORDER BY n DESC, activity LIMIT {TOP_K}"""
    q["q_proc_matrix"] = f"""
WITH {LOG}
SELECT case_id, {_PCOUNTS} FROM log WHERE activity IN ({", ".join(_sql_str(v) for v in VOCAB)})
GROUP BY case_id"""
    q["q_case_features"] = f"""
WITH {SUMMARY},
m AS (SELECT case_id, {_PCOUNTS} FROM log GROUP BY case_id)
SELECT summ.*, encounter_duration_minutes / 60.0 AS total_hours,
       {", ".join(f"coalesce(m.proc_count__{v}, 0) AS proc_count__{v}" for v in VOCAB)}
FROM summ LEFT JOIN m USING (case_id) WHERE encounter_duration_minutes > 0"""
    q["q_topk_rows"] = f"""
WITH {LOG},
top AS (SELECT activity FROM log GROUP BY activity ORDER BY count(*) DESC, activity LIMIT {TOPK_ROWS_K})
SELECT * FROM log WHERE activity IN (SELECT activity FROM top)"""
    q["q_filter_kpis"] = f"""
WITH {SV},
x AS (SELECT *, CASE WHEN arrival_hour >= 6 AND arrival_hour < 18 THEN 'Day (06-18)' ELSE 'Night (18-06)' END
              AS tod FROM sv)
SELECT CASE WHEN grouping(tod) = 1 THEN 'All Day' ELSE tod END AS time_filter,
       CASE WHEN grouping(year_week) = 1 THEN 'All Weeks' ELSE year_week END AS week_filter,
       CASE WHEN grouping(day_type) = 1 THEN 'All' ELSE day_type END AS day_type_filter,
       count(*) AS n_patients, avg(service_min) AS avg_wait_min
FROM x GROUP BY CUBE (tod, year_week, day_type)"""
    q["q_weeks"] = f"WITH {SV} SELECT DISTINCT year_week FROM sv ORDER BY year_week"
    q["q_daily_mean"] = f"""
WITH {SV},
a AS (SELECT day_no, avg(service_min) AS avg_wait_min FROM sv GROUP BY day_no)
SELECT days.day_no, days.day_name, a.avg_wait_min FROM days LEFT JOIN a USING (day_no) ORDER BY day_no"""
    q["q_hourly_mean"] = f"""
WITH {SV}
SELECT arrival_hour, avg(service_min) AS avg_wait_min, avg(service_min) > 60.0 AS above_limit
FROM sv GROUP BY arrival_hour ORDER BY arrival_hour"""
    hcols = ", ".join(f"avg(service_min) FILTER (WHERE arrival_hour = {h}) AS h{h:02d}" for h in range(24))
    q["q_heatmap"] = f"""
WITH {SV},
p AS (SELECT day_no, {hcols} FROM sv GROUP BY day_no)
SELECT days.day_no, days.day_name, {", ".join(f"p.h{h:02d}" for h in range(24))}
FROM days LEFT JOIN p USING (day_no) ORDER BY day_no"""
    slots = f"""
WITH {SV},
a AS (SELECT day_no, arrival_hour, avg(service_min) AS slot_mean, count(*) AS slot_n
      FROM sv GROUP BY 1, 2),
f AS (SELECT days.day_no, days.day_name, h.arrival_hour, coalesce(a.slot_n, 0) AS slot_n,
             coalesce(a.slot_mean, 30.0) AS predicted_min, coalesce(a.slot_mean, 30.0) > 60.0 AS congested
      FROM days CROSS JOIN (SELECT CAST(range AS INTEGER) AS arrival_hour FROM range(24)) h
      LEFT JOIN a ON a.day_no = days.day_no AND a.arrival_hour = h.arrival_hour)"""
    q["q_slot_forecast"] = slots + "\nSELECT * FROM f ORDER BY day_no, arrival_hour"
    q["q_mae"] = slots + """
SELECT count(*) AS n, avg(abs(sv.service_min - f.predicted_min)) AS mae
FROM sv JOIN f ON sv.day_no = f.day_no AND sv.arrival_hour = f.arrival_hour"""
    night = "(arrival_hour >= 18 OR arrival_hour < 6) AND day_type = 'Weekday'"
    for name in ("q_daily_mean", "q_hourly_mean", "q_heatmap", "q_slot_forecast"):
        q[f"{name}_filtered"] = q[name].replace("FROM sv", f"FROM (SELECT * FROM sv WHERE {night}) AS sv")
    q["q_describe"] = f"""
WITH {DUR}
SELECT count, mean, std, min, {_npq('v', 0.25)} AS p25, {_npq('v', 0.5)} AS p50, {_npq('v', 0.75)} AS p75, max
FROM (SELECT count(duration_min) AS count, avg(duration_min) AS mean, stddev_samp(duration_min) AS std, min(duration_min) AS min,
             max(duration_min) AS max, list(duration_min ORDER BY duration_min) AS v
      FROM dur WHERE duration_min IS NOT NULL)"""
    q["q_histogram"] = f"WITH {DUR}, {_HIST}"
    q["q_duration_box"] = f"""
WITH {DUR},
top AS (SELECT activity, row_number() OVER (ORDER BY count(*) DESC, activity) AS grp_no
        FROM posd GROUP BY activity ORDER BY count(*) DESC, activity LIMIT {DURATION_BOX_K}),
v AS (SELECT activity, duration_min AS value FROM posd WHERE activity IN (SELECT activity FROM top)),
lists AS (SELECT activity, avg(value) AS mean, list(value ORDER BY value) AS l FROM v GROUP BY activity),
q AS (SELECT activity, len(l) AS n, mean, {_npq('l', 0.25)} AS q1, {_npq('l', 0.5)} AS median, {_npq('l', 0.75)} AS q3 FROM lists),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q),
w AS (SELECT v.activity,
             min(CASE WHEN value >= lo_f AND value <= hi_f THEN value END) AS whisker_lo,
             max(CASE WHEN value >= lo_f AND value <= hi_f THEN value END) AS whisker_hi,
             CAST(sum(CASE WHEN value >= lo_f AND value <= hi_f THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
      FROM v JOIN f USING (activity) GROUP BY 1)
SELECT top.activity, coalesce(f.n, 0) AS n, f.mean, f.q1, f.median, f.q3, f.iqr,
       w.whisker_lo, w.whisker_hi, coalesce(w.n_outliers, 0) AS n_outliers
FROM top LEFT JOIN f USING (activity) LEFT JOIN w USING (activity) ORDER BY grp_no"""
    q["q_capped"] = f"WITH {DUR} SELECT event_id, duration_min, duration_capped FROM capped"
    q["q_longest"] = f"""
WITH {DUR}
SELECT start_ts, end_ts, activity, duration_min, duration_capped FROM capped
ORDER BY duration_min DESC, event_id LIMIT 5"""
    q["q_normalise_activity"] = f"""
SELECT p_partkey, p_name, {_collapse_sql(_norm_sql('p_name'), PART_RULES)} AS activity FROM part"""
    q["q_label_minutes"] = _label_sql()
    q["q_multi_hot"] = f"""
WITH {LOG}
SELECT case_id, {", ".join(f"max(CASE WHEN activity = '{v}' THEN 1 ELSE 0 END) AS proc_count__{v}" for v in VOCAB)}
FROM log GROUP BY case_id"""
    q["q_training_rows"] = f"""
WITH {LOG}
SELECT event_id, {_minutes('start_ts', 'end_ts')} AS Waiting_Time_Mins, CAST(isodow(start_ts) - 1 AS INTEGER) AS Day_Index,
       CAST(hour(start_ts) AS INTEGER) AS Arrival_Hour
FROM log WHERE {_minutes('start_ts', 'end_ts')} >= 0"""
    q["q_chrono_split"] = f"""
WITH {SUMMARY},
s AS (SELECT * FROM summ WHERE encounter_duration_minutes > 0),
cut AS (SELECT {_npq('v', 1.0 - VAL_FRACTION)} AS c
        FROM (SELECT list(CAST(epoch_us(encounter_start) AS DOUBLE) ORDER BY encounter_start) AS v FROM s))
SELECT case_id, encounter_start, encounter_duration_minutes,
       CASE WHEN epoch_us(encounter_start) <= (SELECT c FROM cut) THEN 'train' ELSE 'val' END AS split
FROM s"""
    # Written and read back.
    text = f"WITH l AS ({q['q_clean_log']}) SELECT * EXCLUDE (event_id) FROM l"
    q["q_raw_ingest"] = text
    q["q_raw_first_cases"] = f"""
WITH l AS ({q['q_clean_log']}),
first_20 AS (SELECT case_id FROM l GROUP BY case_id ORDER BY max(event_id) DESC LIMIT 20)
SELECT * EXCLUDE (event_id) FROM l WHERE case_id IN (SELECT case_id FROM first_20)"""
    q["q_strict_log"] = f"WITH {LOG} SELECT * FROM log"
    q["q_dated_days_off"] = f"""
WITH {SV}
SELECT case_id, activity, start_ts, end_ts, event_ts, event_id, CAST(start_ts AS DATE) AS start_date FROM sv WHERE day_type <> 'Weekday'"""

    q["q_bucketed_transitions"] = q["q_transitions"]

    def stamp(c: str) -> str:
        return (f"strftime({c}, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' "
                f"ELSE strftime({c}, '.%f') END || '+00:00'")

    q["q_transition_report"] = f"""
WITH t AS ({q['q_transitions']})
SELECT CAST(case_id AS VARCHAR) AS case_concept_name, activity AS concept_name, next_activity, {stamp('start_ts')} AS start_timestamp,
       {stamp('next_start')} AS next_start, CAST(start_date AS VARCHAR) AS date, CASE WHEN is_holiday THEN 'True' ELSE 'False' END AS is_holiday,
       CASE WHEN is_weekend THEN 'True' ELSE 'False' END AS is_weekend, day_type
FROM t"""
    q["q_feature_store"] = q["q_case_features"]
    q["q_model_store"] = f"""
WITH p AS ({q['q_stump_calendar']}), {LOG},
e AS (SELECT round(avg(abs({_minutes('start_ts', 'end_ts')} - m)), 6) AS mae
      FROM (SELECT *, avg({_minutes('start_ts', 'end_ts')}) OVER (
              PARTITION BY (CASE split_feature WHEN 'Day_Index' THEN Day_Index ELSE Arrival_Hour END) <= threshold) AS m
            FROM log JOIN p ON isodow(start_ts) - 1 = Day_Index AND hour(start_ts) = Arrival_Hour WHERE end_ts >= start_ts))
SELECT Day_Index, Arrival_Hour, predicted_min, mae FROM p, e"""
    return q
