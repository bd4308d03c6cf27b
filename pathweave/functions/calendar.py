"""Calendar labels: hour, weekday, week label, weekend, day/night, holidays.

Holidays are evaluated as a pure expression of the date (no join, no
shuffle, stays inside whole-stage codegen).  A user-supplied holiday table can
be used instead through :func:`with_holiday_table`.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names, Monday first (index = Python weekday()).
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Public US federal holiday rules (modern form, in force since
# 1978) and the Massachusetts state addition.  Fixed-date days that fall on a
# Saturday are observed the Friday before, on a Sunday the Monday after.
# (name, month, day, first year or None)
FIXED_DATE_HOLIDAYS = [
    ("New Year's Day", 1, 1, None),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, None),
    ("Veterans Day", 11, 11, None),
    ("Christmas Day", 12, 25, None),
]
# (name, month, weekday Monday=0, n-th occurrence; -1 = last)
NTH_WEEKDAY_HOLIDAYS = [
    ("Martin Luther King Jr. Day", 1, 0, 3),
    ("Washington's Birthday", 2, 0, 3),
    ("Memorial Day", 5, 0, -1),
    ("Labor Day", 9, 0, 1),
    ("Columbus Day", 10, 0, 2),
    ("Thanksgiving Day", 11, 3, 4),
]
REGION_HOLIDAYS = {
    "MA": [("Patriots' Day", 4, 0, 3)],
}
# Days in each month of a non-leap year, used only for "last weekday" rules in
# months whose length never varies (May).
_MONTH_DAYS = {1: 31, 3: 31, 4: 30, 5: 31, 6: 30, 7: 31, 8: 31, 9: 30, 10: 31, 11: 30, 12: 31}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour_of(ts) -> Column:
    return F.hour(_c(ts))


def weekday_index(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (Python's ``weekday()``)."""
    return F.weekday(_c(ts))


def day_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def year_week(ts) -> Column:
    """strftime ``%Y - Week %U``: weeks start on Sunday, days before the first Sunday are week 00."""
    c = _c(ts)
    week = F.floor((F.dayofyear(c) + F.lit(7) - F.dayofweek(c)) / F.lit(7)).cast("int")
    return F.format_string("%04d - Week %02d", F.year(c), week)


def is_weekend(ts) -> Column:
    return F.weekday(_c(ts)) >= F.lit(5)


def time_of_day(ts) -> Column:
    """'day' for 06:00 <= t < 18:00, else 'night'."""
    h = F.hour(_c(ts))
    return F.when((h >= 6) & (h < 18), F.lit("day")).otherwise(F.lit("night"))


def _fixed_hit(x: Column) -> Column:
    """x (a date) is one of the fixed-date holidays: month*100 + day in a key list."""
    key = F.month(x) * 100 + F.dayofmonth(x)
    always = [m * 100 + d for _, m, d, since in FIXED_DATE_HOLIDAYS if not since]
    hit = key.isin(always)
    for _, m, d, since in FIXED_DATE_HOLIDAYS:
        if since:
            hit = hit | ((key == m * 100 + d) & (F.year(x) >= since))
    return hit


def _nth_hit(d: Column, rules) -> Column:
    """n-th weekday of a month: code month*100 + weekday*10 + (day-1) div 7 in a list;
    "last weekday" rules test the final seven days of the month."""
    m, dom, wd = F.month(d), F.dayofmonth(d), F.weekday(d)
    code = m * 100 + wd * 10 + F.floor((dom - 1) / 7).cast("int")
    hit = code.isin([mm * 100 + w * 10 + (n - 1) for _, mm, w, n in rules if n > 0])
    for _, mm, w, n in rules:
        if n == -1:
            hit = hit | ((m == mm) & (wd == w) & (dom > _MONTH_DAYS[mm] - 7))
    return hit


def is_holiday(ts, region: str | None = None) -> Column:
    """True when the date of ``ts`` is a (observed) US federal holiday, plus
    the holidays of ``region`` (e.g. ``"MA"``).

    A Friday also stands for the Saturday after it and a Monday for the
    Sunday before it (observed days), so the fixed-date test runs on the date
    and on that shifted date.  Given a column name, the (unresolved)
    expression is built once and reused.
    """
    if isinstance(ts, str):
        return _is_holiday_named(ts, region)
    return _is_holiday(ts, region)


@lru_cache(maxsize=64)
def _is_holiday_named(name: str, region):
    return _is_holiday(F.col(name), region)


def _is_holiday(ts, region):
    d = F.to_date(_c(ts))
    wd = F.weekday(d)
    shifted = F.when(wd == 4, F.date_add(d, 1)).when(wd == 0, F.date_sub(d, 1))
    rules = NTH_WEEKDAY_HOLIDAYS + REGION_HOLIDAYS.get(region or "", [])
    cond = _fixed_hit(d) | F.coalesce(_fixed_hit(shifted), F.lit(False)) | _nth_hit(d, rules)
    return F.when(d.isNull(), F.lit(None).cast("boolean")).otherwise(cond)


def day_type(holiday: Column, weekend: Column, labels=("holiday", "weekend", "weekday")) -> Column:
    """Holiday wins over weekend, weekend over weekday."""
    return (F.when(holiday, F.lit(labels[0]))
            .when(weekend, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def with_holiday_table(df: DataFrame, ts_col: str, holidays: DataFrame,
                       date_col: str = "date", out: str = "is_holiday") -> DataFrame:
    """Flag rows whose date is in ``holidays`` (left join on date).

    The holiday side is de-duplicated first; the planner broadcasts it by its size.
    """
    hol = (holidays.select(F.to_date(F.col(date_col)).alias("_hday")).distinct()
           .withColumn("_hflag", F.lit(True)))
    return (df.withColumn("_hday", F.to_date(F.col(ts_col)))
            .join(hol, "_hday", "left")
            .withColumn(out, F.coalesce(F.col("_hflag"), F.lit(False)))
            .drop("_hday", "_hflag"))
