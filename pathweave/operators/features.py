"""Per-case features: duration summary, activity counts, top-k selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.encode import PREFIX, count_columns  # noqa: F401
from pathweave.functions.timefns import minutes_between



def case_summary(log: DataFrame, case_col: str = "case_id") -> DataFrame:
    """min start, max end, event count, duration minutes (> 0 only), hours."""
    s = log.groupBy(case_col).agg(
        F.min("start_ts").alias("encounter_start"),
        F.max("end_ts").alias("encounter_end"),
        F.count("activity").alias("event_count"))
    s = s.withColumn("encounter_duration_minutes", minutes_between("encounter_start", "encounter_end"))
    return (s.filter(F.col("encounter_duration_minutes") > 0)
            .withColumn("total_hours", F.col("encounter_duration_minutes") / F.lit(60.0)))


def _trimmed(log: DataFrame, col: str = "activity") -> DataFrame:
    return log.withColumn(col, F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))


def top_activities(log: DataFrame, k: int = 50, col: str = "activity") -> DataFrame:
    """Value counts, top ``k`` by count (ties broken by name)."""
    return (_trimmed(log, col).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col).asc()).limit(k))


def top_activity_list(log: DataFrame, k: int = 50, col: str = "activity") -> list[str]:
    """The top-k names as a Python list (at most ``k`` values reach the driver)."""
    return [r[col] for r in top_activities(log, k, col).collect()]


def topk_rows(log: DataFrame, k: int = 10, col: str = "activity") -> DataFrame:
    """Rows whose (trimmed) activity is among the top ``k`` (left-semi join with k rows at most)."""
    top = top_activities(log, k, col).select(col)
    return _trimmed(log, col).join(top, col, "left_semi")


def _count_cols(names, col: str = "activity"):
    """[(column name, count)] in alphabetical order of the labels."""
    a = F.col(col)
    return [(c, F.count_if(a == F.lit(n))) for n, c in count_columns(names)]


def proc_matrix(log: DataFrame, k: int = 50, names: list[str] | None = None, case_col: str = "case_id") -> DataFrame:
    """Per case, count of each top-k activity (columns ``proc_count__<name>``, alphabetical).

    Cases without any top-k activity are absent (as in an unstack); the
    top-k list is computed first (a small job, <= k names).
    """
    names = names if names is not None else top_activity_list(log, k)
    t = _trimmed(log).filter(F.col("activity").isin(names))
    counts = _count_cols(names)
    out = t.groupBy(case_col).agg(F.count(F.lit(1)).alias("_all"), *[n.alias(f"_p{i}") for i, (_, n) in enumerate(counts)])
    return out.drop("_all").toDF(case_col, *[c for c, _ in counts])


def case_features(log: DataFrame, k: int = 50, names: list[str] | None = None,
                  case_col: str = "case_id") -> DataFrame:
    """Duration summary left-joined with activity counts, missing counts 0.

    Fused into a single aggregation over the log (one scan, one shuffle on the
    case key): conditional counts give 0 where the pivot + left join + fill
    would.
    """
    names = names if names is not None else top_activity_list(log, k)
    counts = _count_cols(names)
    s = _trimmed(log).groupBy(case_col).agg(
        F.min("start_ts").alias("encounter_start"),
        F.max("end_ts").alias("encounter_end"),
        F.count("activity").alias("event_count"),
        *[n.alias(f"_p{i}") for i, (_, n) in enumerate(counts)])
    s = s.withColumn("encounter_duration_minutes", minutes_between("encounter_start", "encounter_end"))
    s = (s.filter(F.col("encounter_duration_minutes") > 0)
         .withColumn("total_hours", F.col("encounter_duration_minutes") / F.lit(60.0)))
    head = [case_col, "encounter_start", "encounter_end", "event_count", "encounter_duration_minutes", "total_hours"]
    return s.select(*head, *[f"_p{i}" for i in range(len(counts))]).toDF(*head, *[c for c, _ in counts])
