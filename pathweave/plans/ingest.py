"""Raw event table -> cleaned canonical log (all cases, or the first N on request) -> written log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.clean import ingest_raw
from pathweave.sources.eventlog import read_raw_csv, write_log


def ingest_log(spark: SparkSession, raw_path: str, sep: str = ";", n_cases: int | None = None,
               ntz: bool = False, multiline: bool = False) -> DataFrame:
    """Parse leniently, fill missing activity, drop incomplete rows.

    ``n_cases`` keeps only the first so many cases; by default all are kept.

    "First" is file order: by file path, then by place in the file.
    """
    if not n_cases:
        return ingest_raw(read_raw_csv(spark, raw_path, sep, multiline=multiline), ntz=ntz)
    raw = read_raw_csv(spark, raw_path, sep, multiline=multiline, file_order=True)
    # Rows that the cleaning drops do not make a case part of the cohort.
    log = ingest_raw(raw, ntz=ntz, extra=("_file", "_block", "_pos"))
    cohort = (log.groupBy("case_id").agg(F.min(F.struct("_file", "_block", "_pos")).alias("_first"))
              .orderBy("_first").limit(n_cases).select("case_id"))
    return log.join(cohort, "case_id", "left_semi").drop("_file", "_block", "_pos")


def ingest_and_write(spark: SparkSession, raw_path: str, out_path: str, fmt: str = "csv",
                     n_cases: int | None = None, n_files: int | None = None, multiline: bool = False) -> str:
    """The ingest stage: cleaned log written sorted by (case, start, stop); returns the path."""
    return write_log(ingest_log(spark, raw_path, n_cases=n_cases, multiline=multiline), out_path, fmt=fmt, n_files=n_files)
