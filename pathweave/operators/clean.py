"""Log cleaning: parse, fill, drop, cohort selection, minimum case size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.timefns import parse_ts_lenient

UNKNOWN_ACTIVITY = "UNKNOWN_ACTIVITY"


def fill_activity(df: DataFrame, col: str = "activity", value: str = UNKNOWN_ACTIVITY) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def drop_incomplete(df: DataFrame, subset) -> DataFrame:
    return df.na.drop(subset=list(subset))


def ingest_raw(raw: DataFrame, ntz: bool = False, id_col: str | None = None, extra=()) -> DataFrame:
    """Raw (ENCOUNTER, START, STOP, DESCRIPTION) text -> canonical log.

    Unparseable times become null and the row is dropped; a null
    description becomes UNKNOWN_ACTIVITY *before* the drop, so it never costs
    a row.  ``event_id`` is a tie-break id assigned once at ingest; columns
    named in ``extra`` are carried along.
    """
    rid = [F.col(id_col).alias("_rid")] if id_col else []
    df = raw.select(
        F.col("ENCOUNTER").alias("case_id"),
        F.col("DESCRIPTION").alias("activity"),
        parse_ts_lenient("START", ntz=ntz).alias("start_ts"),
        parse_ts_lenient("STOP", ntz=ntz).alias("end_ts"),
        *rid, *extra,
    )
    df = fill_activity(df)
    df = drop_incomplete(df, ["case_id", "start_ts", "end_ts", "activity"])
    eid = F.col("_rid") if id_col else F.monotonically_increasing_id()
    return df.select("case_id", "activity", "start_ts", "end_ts", F.col("start_ts").alias("event_ts"),
                     eid.alias("event_id"), *extra)


def clean_log(log: DataFrame) -> DataFrame:
    """Fill activity, then drop rows missing case, activity or either time."""
    return drop_incomplete(fill_activity(log), ["case_id", "activity", "start_ts", "end_ts"])


def relabel_distinct(df: DataFrame, relabel: Callable[[Column], Column], col: str = "activity") -> DataFrame:
    """``col`` replaced by ``relabel(col)``, which is computed once per distinct value.

    For costly rules (many patterns) on logs with few labels and many rows: the distinct values are
    found by a partial aggregation that reads this column only, relabelled, and joined back
    null-safe without a hint, so that the planner broadcasts them by their size, and otherwise a
    label of very many rows is split by adaptive execution.  ``df`` is evaluated twice, and
    ``relabel`` must depend on its argument alone.  Columns keep their order; null values take part.
    """
    if df.columns.count(col) != 1:
        raise ValueError(f"{col!r} is not one column of {df.columns}")
    at = df.columns.index(col)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    words = plain.select(F.col(f"_c{at}").alias("_old")).distinct().withColumn("_new", relabel(F.col("_old")))
    joined = plain.join(words, F.col(f"_c{at}").eqNullSafe(F.col("_old")))
    return joined.select(*[F.col("_new" if i == at else f"_c{i}") for i in range(len(df.columns))]).toDF(*df.columns)


def _order_key(log: DataFrame, time_col: str, id_col: str):
    """(time, id) packed into one decimal(38,0) with the same order:
    micros * 10^20 + (id + 2^63).  A decimal buffer keeps ``min`` hash-based."""
    from pathweave.operators.trace import epoch_micros
    us = epoch_micros(log, time_col).cast("decimal(38,0)")
    rid = F.col(id_col).cast("decimal(38,0)") + F.lit(str(2 ** 63)).cast("decimal(38,0)")
    return us * F.lit(str(10 ** 20)).cast("decimal(38,0)") + rid


def first_n_cases(log: DataFrame, n: int = 50, order_cols=("start_ts", "event_id"),
                  case_col: str = "case_id") -> DataFrame:
    """Keep the rows of the first ``n`` distinct cases in (explicit) log order.

    "File order" is made explicit by ``order_cols``.  The per-case minimum is
    a partial (hash) aggregation, the top ``n`` a TakeOrderedAndProject, and
    the cohort joins back as a left-semi join (broadcast by size at run time).
    """
    types = dict(log.dtypes)
    if len(order_cols) == 1:
        key = F.col(order_cols[0])
    elif (len(order_cols) == 2 and types.get(order_cols[0]) in ("timestamp", "timestamp_ntz")
            and types.get(order_cols[1]) in ("bigint", "int")):
        key = _order_key(log, *order_cols)
    else:
        key = F.struct(*[F.col(c) for c in order_cols])
    firsts = log.groupBy(case_col).agg(F.min(key).alias("_first"))
    cohort = firsts.orderBy(F.col("_first").asc(), F.col(case_col).asc()).limit(n).select(case_col)
    return log.join(cohort, case_col, "left_semi")


def case_sizes(log: DataFrame, case_col: str = "case_id") -> DataFrame:
    return log.groupBy(case_col).agg(F.count(F.lit(1)).alias("n_events"))


def min_case_size(log: DataFrame, k: int = 2, case_col: str = "case_id") -> DataFrame:
    """Rows of cases with at least ``k`` events (rows without a case are dropped).

    Case sizes come from a partial aggregation; the cases that are too small
    (usually few) leave by an anti join.  Adaptive execution broadcasts their
    list if it is small when it is there; otherwise the join shuffles on the
    case key, and a hot case on the log side is split as a skewed partition.
    """
    known = log.filter(F.col(case_col).isNotNull())
    small = case_sizes(known, case_col).filter(F.col("n_events") < k).select(case_col)
    return known.join(small, case_col, "left_anti")
