"""Scans and sinks for event logs, transition reports, features and models."""

from pathweave.sources.eventlog import (
    LOG_COLUMNS, REFERENCE_NAMES, read_raw_csv, read_csv_stripped, read_log, events_as_log,
    write_log, write_dated_log, read_dated_log, write_transitions, write_features, to_reference_names, from_reference_names,
    TRANSITION_COLUMNS,
)

__all__ = [
    "LOG_COLUMNS", "REFERENCE_NAMES", "read_raw_csv", "read_csv_stripped", "read_log", "events_as_log",
    "write_log", "write_dated_log", "read_dated_log", "write_transitions", "write_features", "to_reference_names", "from_reference_names",
    "TRANSITION_COLUMNS",
]
