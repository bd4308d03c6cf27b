"""Column-level functions: built-in Spark expressions only (no Python UDFs)."""

from pathweave.functions.timefns import (
    minutes_between, round2, clip_lower, clip_upper, parse_ts_lenient, parse_ts_strict,
)
from pathweave.functions.calendar import (
    hour_of, weekday_index, day_name, year_week, is_weekend, time_of_day, day_type,
    is_holiday, with_holiday_table, DAY_ORDER,
)
from pathweave.functions.labels import (
    normalise_text, collapse_labels, CLINICAL_RULES, duration_label_to_minutes,
)
from pathweave.functions.encode import multi_hot

__all__ = [
    "minutes_between", "round2", "clip_lower", "clip_upper", "parse_ts_lenient", "parse_ts_strict",
    "hour_of", "weekday_index", "day_name", "year_week", "is_weekend", "time_of_day", "day_type",
    "is_holiday", "with_holiday_table", "DAY_ORDER",
    "normalise_text", "collapse_labels", "CLINICAL_RULES", "duration_label_to_minutes", "multi_hot",
]
