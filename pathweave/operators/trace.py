"""Traces: ordered events of a case, successor columns, the transition table.

The trace order is (start_ts, end_ts, event_id) within ``case_id``.

Skew.  A window partitioned by case puts a whole case in one task.  When a
case is "hot" (more than ``hot_case_rows`` events, counted in every run) the
log is range-partitioned by (case, start, end, event id) into segments of
about ``segment_rows`` rows and written once to the shared folder.  The key
holds the unique event id, so even a case whose events share one timestamp
is split, and the number of segments follows from the rows, without a limit.
The window then runs per (case, segment), and the last row of a segment
takes its successor from the case's next segment.  Without a hot case the
plan is one exchange on ``case_id`` plus a sort, shared by every lead.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.calendar import day_type, is_holiday, is_weekend, time_of_day
from pathweave.functions.timefns import clip_lower, minutes_between, round2

ORDER = ["start_ts", "end_ts", "event_id"]


@dataclass(frozen=True)
class SkewPolicy:
    """When to split a case, and how large the pieces are."""
    hot_case_rows: int = 2_000_000
    segment_rows: int = 500_000


DEFAULT_SKEW = SkewPolicy()


class CaseSizes(NamedTuple):
    """Rows of the largest case and of the log, where they are known beforehand (upper bounds do)."""
    largest_case: int
    rows: int


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 for TIMESTAMP and TIMESTAMP_NTZ alike."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col))


def trace_window(case_col: str = "case_id", extra_partition=(), order=ORDER):
    return Window.partitionBy(case_col, *extra_partition).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _segments(log: DataFrame, case_col: str, order, policy: SkewPolicy, sizes: CaseSizes | None = None) -> DataFrame | None:
    """The log with a segment number, written once; None if no case is hot."""
    from pathweave.operators.stats import materialize
    if sizes is None:
        counted = log.groupBy(case_col).agg(F.count(F.lit(1)).alias("_n"))
        sizes = CaseSizes(*counted.agg(F.max("_n"), F.sum("_n")).first())
    if (sizes.largest_case or 0) <= policy.hot_case_rows:
        return None
    parts = max(2, -(-sizes.rows // policy.segment_rows))
    ranged = log.repartitionByRange(parts, case_col, *[F.col(c).asc_nulls_first() for c in order])
    return materialize(ranged.withColumn("_seg", F.spark_partition_id()), "segments")


def _encoded(log: DataFrame, col: str):
    """(log with ``col`` replaced by a numeric code, dictionary written once)."""
    from pathweave.operators.stats import materialize
    acts = log.select(col).where(F.col(col).isNotNull()).distinct()
    dic = materialize(acts.select(col, F.monotonically_increasing_id().alias("_code")), "activity-codes")
    return log.join(dic, col, "left").drop(col).withColumnRenamed("_code", col), dic


def with_successor(log: DataFrame, lead_cols: dict | None = None, case_col: str = "case_id",
                   order=ORDER, policy: SkewPolicy | None = DEFAULT_SKEW,
                   encode_activities: bool = False, sizes: CaseSizes | None = None) -> DataFrame:
    """Add successor columns: ``{out_name: source_col}`` (default next_start, next_activity).

    ``policy=None`` forces the plain single-window plan.  With
    ``encode_activities`` the activity text is replaced by a numeric code
    before the case shuffle and decoded after the window, so the shuffle
    carries 8 bytes instead of the text.  ``sizes`` (of a bucketed log)
    spares the count of the largest case.
    """
    lead_cols = lead_cols or {"next_start": "start_ts", "next_activity": "activity"}
    if encode_activities and "activity" in log.columns:
        enc, dic = _encoded(log, "activity")
        out = with_successor(enc.select(*log.columns), lead_cols, case_col, order, policy, False, sizes)
        names = dic.select(F.col("_code").alias("_c"), F.col("activity").alias("_name"))
        for c in ["activity"] + [o for o, src in lead_cols.items() if src == "activity"]:
            out = (out.join(names, out[c] == F.col("_c"), "left")
                   .drop(c, "_c").withColumnRenamed("_name", c))
        return out.select(*log.columns, *lead_cols)
    seg = None if policy is None else _segments(log, case_col, order, policy, sizes)
    if seg is None:
        w = trace_window(case_col, order=order)
        return log.select("*", *[F.lead(src).over(w).alias(out) for out, src in lead_cols.items()])

    w = trace_window(case_col, ["_seg"], order)
    body = seg.select("*", F.lead(F.lit(1)).over(w).isNull().alias("_tail"),
                      *[F.lead(src).over(w).alias(out) for out, src in lead_cols.items()])
    # First row of every (case, segment), then the head of the case's next segment.
    head = F.struct(*[F.col(src).alias(out) for out, src in lead_cols.items()])
    heads = seg.groupBy(case_col, "_seg").agg(F.min_by(head, F.struct(*[F.col(c) for c in order])).alias("_h"))
    nxt = heads.select(case_col, "_seg", F.lead("_h").over(Window.partitionBy(case_col).orderBy("_seg")).alias("_nh"))
    nxt = nxt.filter(F.col("_nh").isNotNull()).select(F.col(case_col).alias("_case"), F.col("_seg").alias("_s"), "_nh")
    out = body.join(nxt, F.col(case_col).eqNullSafe(F.col("_case")) & (F.col("_seg") == F.col("_s")), "left")
    for o in lead_cols:
        out = out.withColumn(o, F.when(F.col("_tail") & F.col("_nh").isNotNull(), F.col(f"_nh.{o}")).otherwise(F.col(o)))
    return out.drop("_seg", "_tail", "_nh", "_case", "_s")


def case_endpoints(log: DataFrame, case_col: str = "case_id", order=ORDER, activity: str = "activity") -> DataFrame:
    """Per case: event count, first and last activity (partial aggregation; skew-safe)."""
    key = F.struct(*[F.col(c) for c in order])
    return log.groupBy(case_col).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min_by(activity, key).alias("first_activity"),
        F.max_by(activity, key).alias("last_activity"),
    )


def transitions(log: DataFrame, region: str | None = "MA", policy: SkewPolicy | None = DEFAULT_SKEW,
                extra_labels: bool = False, encode_activities: bool = False, sizes: CaseSizes | None = None) -> DataFrame:
    """One row per (event, its successor) within a case.

    raw_gap_min = next_start - end (may be negative for overlapping events),
    waiting_min = raw gap clipped at 0; both rounded to 2 decimals like numpy.
    Calendar labels are computed from the start of the current event.
    """
    x = with_successor(log, policy=policy, encode_activities=encode_activities, sizes=sizes)
    t = (x.select("*", round2(minutes_between(F.col("end_ts"), F.col("next_start"))).alias("raw_gap_min"))
         .filter(F.col("next_activity").isNotNull() & F.col("raw_gap_min").isNotNull()))
    # Holiday flag in its own projection; the day type then reads the column (computed once per row).
    t = t.select("*", round2(clip_lower(F.col("raw_gap_min"), 0.0)).alias("waiting_min"),
                 is_holiday("start_ts", region).alias("is_holiday"))
    wkend = is_weekend(F.col("start_ts"))
    cols = [
        "case_id", "activity", "next_activity", "start_ts", "end_ts", "next_start",
        "raw_gap_min", "waiting_min",
        F.to_date("start_ts").alias("start_date"),
        "is_holiday",
        wkend.alias("is_weekend"),
        day_type(F.col("is_holiday"), wkend).alias("day_type"),
    ]
    if extra_labels:
        cols += [F.hour("start_ts").alias("hour"), time_of_day(F.col("start_ts")).alias("time_of_day")]
    return t.select(*cols)
