"""Event log -> directly-follows graph, transitions and waiting-time statistics.

The successor window is computed once.  With ``materialize=True`` the
transition table is written as Parquet to the shared checkpoint folder and
read back, so the seven downstream summaries scan it instead of re-running
the window (lineage is cut; a lost executor recomputes from the written
files, not from the raw log).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.labels import CLINICAL_RULES, collapse_labels, normalise_text
from pathweave.operators import dfg, stats
from pathweave.operators.clean import min_case_size
from pathweave.operators.trace import DEFAULT_SKEW, SkewPolicy, transitions
from pathweave.session import shared_path


@dataclass
class Discovery:
    edges: DataFrame
    starts: DataFrame
    ends: DataFrame
    performance: DataFrame
    transitions: DataFrame
    wait_summary: DataFrame
    box_stats: DataFrame
    ecdf: DataFrame


def write_reports(d: Discovery, out_dir: str, mode: str = "overwrite") -> dict:
    """Persist a discovery: the transition report as CSV (reference text format) and
    the graph and statistics tables as Parquet.  Returns {name: path}."""
    from pathweave.sources.eventlog import write_transitions
    out = {"waiting_transitions": write_transitions(d.transitions, f"{out_dir}/waiting_transitions", mode)}
    for name in ("edges", "starts", "ends", "performance", "wait_summary", "box_stats", "ecdf"):
        path = f"{out_dir}/{name}"
        getattr(d, name).write.mode(mode).parquet(path)
        out[name] = path
    return out


def discover_from_file(spark, path: str, fmt: str = "csv", **kw) -> Discovery:
    """Discovery over a processed log file; timestamps are parsed strictly (bad text fails)."""
    from pathweave.sources.eventlog import read_log
    return discover(read_log(spark, path, fmt=fmt, strict=True), **kw)


def normalise_log(log: DataFrame, rules=CLINICAL_RULES) -> DataFrame:
    """Trim + lower-case the activity, then collapse it with the ordered rules."""
    return (log.withColumn("activity", normalise_text("activity"))
            .withColumn("activity", collapse_labels("activity", rules)))


def discover(log: DataFrame, rules=CLINICAL_RULES, region: str | None = "MA", min_events: int = 2,
             policy: SkewPolicy | None = DEFAULT_SKEW, materialize: bool = False) -> Discovery:
    """``min_events`` drops all smaller cases before anything else (one-event cases have no transition anyway)."""
    log = normalise_log(log, rules) if rules is not None else log
    if min_events > 2:
        log = min_case_size(log, min_events)
    trans = transitions(log, region=region, policy=policy)
    if materialize:
        path = shared_path(log.sparkSession, f"transitions-{uuid.uuid4().hex}")
        trans.write.mode("overwrite").parquet(path)
        trans = log.sparkSession.read.parquet(path)
    # Edges and performance come from the transition rows: every consecutive
    # pair is a transition (cases of one event have none).
    succ = trans.select("activity", "next_activity", "start_ts", "next_start")
    edges = dfg.dfg_edges_from(succ)
    perf = dfg.dfg_performance_from(succ)
    # Start and end activities from one pass over the log; the result has at
    # most two rows per activity and is kept for both readers.
    endpoints = stats.materialize(dfg.dfg_endpoint_counts(log, min_events), "endpoints")
    starts = endpoints.filter(F.col("kind") == "start").select("activity", "n")
    ends = endpoints.filter(F.col("kind") == "end").select("activity", "n")
    # One table of running counts for quantiles and ECDF; log(1 + v) keeps the
    # order, so the box statistics read a projection of the same table.
    counts = stats.cumulative_counts(stats.value_counts(stats.wait_groups_long(trans)), ("dimension", "grp"))
    counts = stats.materialize(counts, "running-counts")
    logc = counts.withColumn("value", F.log(F.lit(1.0) + F.col("value")))
    dim = stats.group_dim(log.sparkSession)
    return Discovery(edges, starts, ends, perf, trans, stats.quantile_summary(counts, dim),
                     stats.box_stats(logc, dim), stats.ecdf(counts))
