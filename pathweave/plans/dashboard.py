"""Raw event table -> the operational views of the dashboard, for one filter state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.timefns import parse_ts_lenient
from pathweave.operators import ops
from pathweave.sources.eventlog import read_csv_stripped


@dataclass
class DashboardViews:
    kpis: DataFrame
    weeks: DataFrame
    daily: DataFrame
    hourly: DataFrame
    heatmap: DataFrame
    forecast: DataFrame


def service_log(spark: SparkSession, raw_path: str, sep: str = ";") -> DataFrame:
    """Stripped headers, lenient START/STOP, rows missing either dropped, as a canonical log."""
    raw = read_csv_stripped(spark, raw_path, sep)
    desc = F.col("DESCRIPTION") if "DESCRIPTION" in raw.columns else F.lit(None).cast("string")
    log = raw.select(F.lit(None).cast("string").alias("case_id"), desc.alias("activity"),
                     parse_ts_lenient("START").alias("start_ts"), parse_ts_lenient("STOP").alias("end_ts"))
    return log.na.drop(subset=["start_ts", "end_ts"])


def dashboard_views(log: DataFrame, tod: str = ops.TOD_ALL, week: str = ops.WEEK_ALL,
                    dtype: str = ops.DAYTYPE_ALL, region: str | None = None) -> DashboardViews:
    """KPIs and trends on the filtered rows; the slot forecast on all rows (as the simulator does)."""
    sv = ops.service_view(log, region)
    filtered = ops.filter_view(sv, tod, week, dtype)
    return DashboardViews(
        kpis=ops.kpis(filtered), weeks=ops.weeks(ops.filter_view(sv, tod)), daily=ops.daily_mean(filtered),
        hourly=ops.hourly_mean(filtered), heatmap=ops.heatmap(filtered), forecast=ops.slot_forecast(sv))
