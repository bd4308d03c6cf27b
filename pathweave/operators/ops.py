"""Operational views over service times: filters, KPIs, trends, heatmap, slot forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.calendar import (
    DAY_ORDER, day_name, day_type, is_holiday, is_weekend, weekday_index, year_week,
)
from pathweave.functions.timefns import clip_lower, minutes_between
from pathweave.operators.stats import small_sorted

# Dashboard constants (congestion limit and forecast fallback, minutes).
CONGESTION_LIMIT_MIN = 60.0
FORECAST_FALLBACK_MIN = 30.0
# Filter option labels.
TOD_ALL, TOD_DAY, TOD_NIGHT = "All Day", "Day (06-18)", "Night (18-06)"
WEEK_ALL = "All Weeks"
DAYTYPE_ALL = "All"
DAYTYPE_LABELS = ("Holiday", "Weekend", "Weekday")


def service_view(log: DataFrame, region: str | None = None) -> DataFrame:
    """Per event: service minutes (stop - start, clipped at 0) and calendar columns."""
    st = F.col("start_ts")
    log = log.withColumn("_hol", is_holiday("start_ts", region))
    return log.select(
        *[c for c in log.columns if c != "_hol"],
        clip_lower(minutes_between(st, F.col("end_ts")), 0.0).alias("service_min"),
        F.hour(st).alias("arrival_hour"),
        day_name(st).alias("day_name"),
        weekday_index(st).alias("day_no"),
        year_week(st).alias("year_week"),
        day_type(F.col("_hol"), is_weekend(st), DAYTYPE_LABELS).alias("day_type"),
    )


def tod_label(hour_col="arrival_hour"):
    h = F.col(hour_col)
    return F.when((h >= 6) & (h < 18), F.lit(TOD_DAY)).otherwise(F.lit(TOD_NIGHT))


def filter_view(sv: DataFrame, tod: str = TOD_ALL, week: str = WEEK_ALL, dtype: str = DAYTYPE_ALL) -> DataFrame:
    """Time-of-day, week and day-type filters; the "All" options filter nothing."""
    h = F.col("arrival_hour")
    if tod == TOD_DAY:
        sv = sv.filter((h >= 6) & (h < 18))
    elif tod == TOD_NIGHT:
        sv = sv.filter((h >= 18) | (h < 6))
    if week != WEEK_ALL:
        sv = sv.filter(F.col("year_week") == F.lit(week))
    if dtype != DAYTYPE_ALL:
        sv = sv.filter(F.col("day_type") == F.lit(dtype))
    return sv


def kpis(sv: DataFrame) -> DataFrame:
    return sv.agg(F.count(F.lit(1)).alias("n_patients"), F.avg("service_min").alias("avg_wait_min"))


def kpi_cube(sv: DataFrame) -> DataFrame:
    """KPIs for every filter state (CUBE over the three filters); a rolled-up
    dimension is the filter's "All" option.

    The log is first aggregated to the finest (time of day, week, day type)
    grain -- a partial aggregation with a tiny output -- and only that table
    is expanded by the cube, so no raw row is copied eight times.
    """
    base = (sv.withColumn("tod", tod_label())
            .groupBy("tod", "year_week", "day_type")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("service_min").alias("_s"),
                 F.count("service_min").alias("_nv")))
    g = (base.cube("tod", "year_week", "day_type")
         .agg(F.sum("_n").alias("n_patients"), (F.sum("_s") / F.sum("_nv")).alias("avg_wait_min"),
              F.grouping("tod").alias("_gt"), F.grouping("year_week").alias("_gw"),
              F.grouping("day_type").alias("_gd")))
    return g.select(
        F.when(F.col("_gt") == 1, F.lit(TOD_ALL)).otherwise(F.col("tod")).alias("time_filter"),
        F.when(F.col("_gw") == 1, F.lit(WEEK_ALL)).otherwise(F.col("year_week")).alias("week_filter"),
        F.when(F.col("_gd") == 1, F.lit(DAYTYPE_ALL)).otherwise(F.col("day_type")).alias("day_type_filter"),
        "n_patients", "avg_wait_min")


def weeks(sv: DataFrame) -> DataFrame:
    """Distinct week labels, sorted (at most 54 per year of data)."""
    return sv.select("year_week").distinct().orderBy("year_week")


def day_dim(spark) -> DataFrame:
    names = F.array(*[F.lit(d) for d in DAY_ORDER])
    return spark.range(7).select(F.col("id").cast("int").alias("day_no"),
                                 F.element_at(names, (F.col("id") + 1).cast("int")).alias("day_name"))


def daily_mean(sv: DataFrame) -> DataFrame:
    """Mean service time for all seven days, Monday first; missing days are null."""
    agg = sv.groupBy("day_no").agg(F.avg("service_min").alias("avg_wait_min"))
    return (day_dim(sv.sparkSession).join(F.broadcast(agg), "day_no", "left")
            .select("day_no", "day_name", "avg_wait_min").transform(lambda d: small_sorted(d, "day_no")))


def hourly_mean(sv: DataFrame, limit: float = CONGESTION_LIMIT_MIN) -> DataFrame:
    return (sv.groupBy("arrival_hour").agg(F.avg("service_min").alias("avg_wait_min"))
            .withColumn("above_limit", F.col("avg_wait_min") > F.lit(limit))
            .transform(lambda d: small_sorted(d, "arrival_hour")))


def heatmap(sv: DataFrame) -> DataFrame:
    """Day x hour mean service time, 7 rows (Monday first) x 24 hour columns h00..h23."""
    piv = sv.groupBy("day_no").pivot("arrival_hour", list(range(24))).agg(F.avg("service_min"))
    piv = piv.select("day_no", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    return (day_dim(sv.sparkSession).join(F.broadcast(piv), "day_no", "left")
            .transform(lambda d: small_sorted(d, "day_no")))


def slot_forecast(sv: DataFrame, fallback: float = FORECAST_FALLBACK_MIN,
                  limit: float = CONGESTION_LIMIT_MIN) -> DataFrame:
    """Forecast per (weekday, hour): the slot's historical mean, else ``fallback``; congestion flag."""
    spark = sv.sparkSession
    slots = day_dim(spark).crossJoin(spark.range(24).select(F.col("id").cast("int").alias("arrival_hour")))
    agg = sv.groupBy("day_no", "arrival_hour").agg(F.avg("service_min").alias("slot_mean"),
                                                   F.count(F.lit(1)).alias("slot_n"))
    return (slots.join(F.broadcast(agg), ["day_no", "arrival_hour"], "left")
            .select("day_no", "day_name", "arrival_hour",
                    F.coalesce("slot_n", F.lit(0)).cast("long").alias("slot_n"),
                    F.coalesce("slot_mean", F.lit(fallback)).alias("predicted_min"))
            .withColumn("congested", F.col("predicted_min") > F.lit(limit))
            .transform(lambda d: small_sorted(d, "day_no", "arrival_hour")))


def mae_against(sv: DataFrame, forecast: DataFrame, label: str = "service_min",
                pred: str = "predicted_min") -> DataFrame:
    """Mean absolute error of a slot forecast (168 rows, broadcast) on the rows of ``sv``."""
    f = F.broadcast(forecast.select("day_no", "arrival_hour", pred))
    return (sv.join(f, ["day_no", "arrival_hour"])
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(label) - F.col(pred))).alias("mae")))
