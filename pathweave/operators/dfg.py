"""Directly-follows graph: edge frequency, start/end activities, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.timefns import round_exact
from pathweave.operators.trace import DEFAULT_SKEW, SkewPolicy, case_endpoints, with_successor


def dfg_edges_from(succ: DataFrame) -> DataFrame:
    """(src, dst, n) from a frame that already has ``next_activity``."""
    return (succ.filter(F.col("next_activity").isNotNull())
            .groupBy(F.col("activity").alias("src"), F.col("next_activity").alias("dst"))
            .agg(F.count(F.lit(1)).alias("n")))


def dfg_edges(log: DataFrame, policy: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """Count of consecutive (a, b) pairs within a case.

    Cases with one event contribute no pair, so the minimum-size filter of
    two events needs no join here.
    """
    return dfg_edges_from(with_successor(log, {"next_activity": "activity"}, policy=policy))


def dfg_endpoint_counts(log: DataFrame, min_events: int = 2) -> DataFrame:
    """(kind, activity, n) for kind in {'start', 'end'} from one pass of per-case endpoints."""
    ends = case_endpoints(log).filter(F.col("n_events") >= min_events)
    both = F.array(F.struct(F.lit("start").alias("kind"), F.col("first_activity").alias("activity")),
                   F.struct(F.lit("end").alias("kind"), F.col("last_activity").alias("activity")))
    return (ends.select(F.explode(both).alias("e")).select("e.kind", "e.activity")
            .groupBy("kind", "activity").agg(F.count(F.lit(1)).alias("n")))


def dfg_start_activities(log: DataFrame, min_events: int = 2) -> DataFrame:
    ends = case_endpoints(log).filter(F.col("n_events") >= min_events)
    return ends.groupBy(F.col("first_activity").alias("activity")).agg(F.count(F.lit(1)).alias("n"))


def dfg_end_activities(log: DataFrame, min_events: int = 2) -> DataFrame:
    ends = case_endpoints(log).filter(F.col("n_events") >= min_events)
    return ends.groupBy(F.col("last_activity").alias("activity")).agg(F.count(F.lit(1)).alias("n"))


def dfg_performance_from(succ: DataFrame) -> DataFrame:
    """Mean start-to-start time per edge (seconds and minutes), with a minutes label."""
    secs = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("next_start")) / F.lit(1e6)
    g = (succ.filter(F.col("next_activity").isNotNull())
         .groupBy(F.col("activity").alias("src"), F.col("next_activity").alias("dst"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg(secs).alias("mean_seconds")))
    return (g.withColumn("mean_minutes", F.col("mean_seconds") / F.lit(60.0))
            .withColumn("label", F.format_string("%.2f min", round_exact(F.col("mean_minutes")))))


def dfg_performance(log: DataFrame, policy: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    return dfg_performance_from(with_successor(log, policy=policy))
