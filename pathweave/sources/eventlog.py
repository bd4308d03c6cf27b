"""Event-log sources and sinks.

Canonical log columns: ``case_id, activity, start_ts, end_ts, event_ts,
event_id``.  Colon names (``case:concept:name`` ...) exist only at the CSV
edges, through :func:`to_reference_names` / :func:`from_reference_names`.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from pathweave.functions.calendar import day_type, is_holiday, is_weekend, year_week
from pathweave.functions.timefns import parse_ts_lenient, parse_ts_strict

LOG_COLUMNS = ["case_id", "activity", "start_ts", "end_ts", "event_ts", "event_id"]

# Canonical column <-> process-mining CSV header names.
REFERENCE_NAMES = {
    "case_id": "case:concept:name",
    "activity": "concept:name",
    "start_ts": "start:timestamp",
    "end_ts": "end:timestamp",
    "event_ts": "time:timestamp",
}

# The 12 columns of the transition report, in order.
TRANSITION_COLUMNS = [
    "case_id", "activity", "next_activity", "start_ts", "end_ts", "next_start",
    "raw_gap_min", "waiting_min", "start_date", "is_holiday", "is_weekend", "day_type",
]

DATE_COLUMN = "start_date"                       # folders of a dated log
DAY_TYPES = ("Holiday", "Weekend", "Weekday")

RAW_COLUMNS = ["ENCOUNTER", "START", "STOP", "DESCRIPTION"]


def _missing(path: str, hint: str = "") -> FileNotFoundError:
    return FileNotFoundError(f"input not found at: {path}. {hint}".strip())


def _guard(read, path: str, hint: str = "") -> DataFrame:
    try:
        return read()
    except AnalysisException as e:  # PATH_NOT_FOUND and friends
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise _missing(path, hint) from e
        raise


def csv_options(io, multiline: bool = False):
    """Quoting as pandas writes it: a quote inside a quoted field is doubled.

    ``multiline`` (readers only) allows line breaks inside quoted fields; such
    files cannot be split, so each is read by one task.
    """
    io = io.option("header", True).option("quote", '"').option("escape", '"')
    return io.option("multiLine", True) if multiline else io


def read_csv_stripped(spark: SparkSession, path: str, sep: str = ";", multiline: bool = False) -> DataFrame:
    """All columns as text, header names stripped of surrounding spaces."""
    df = _guard(lambda: csv_options(spark.read, multiline).option("sep", sep)
                .option("inferSchema", False).csv(path), path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_raw_csv(spark: SparkSession, path: str, sep: str = ";", columns=RAW_COLUMNS, multiline: bool = False,
                 file_order: bool = False) -> DataFrame:
    """Raw hospital-style log: keep only the named columns (pruned at the scan).

    With ``file_order`` three further columns give a row's place in the input:
    ``_file`` (path), ``_block`` (where its split starts) and ``_pos`` (a
    number that grows within a split).
    """
    df = read_csv_stripped(spark, path, sep, multiline)
    if not file_order:
        return df.select(*columns)
    return df.select(*columns, F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"),
                     F.monotonically_increasing_id().alias("_pos"))


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", reference_names: bool | None = None,
             ntz: bool = False, strict: bool = False, multiline: bool = False) -> DataFrame:
    """Canonical log scan: coerce timestamps and drop incomplete rows.

    ``fmt="csv"`` reads a comma CSV with the colon header names used by
    process-mining tools (``reference_names`` defaults to True for CSV).
    Parsing is lenient (bad text -> null -> row dropped) unless ``strict``,
    where bad text fails the job (the discovery stage's contract).
    """
    hint = "Was the ingest step run first?"
    if fmt == "csv":
        df = _guard(lambda: csv_options(spark.read, multiline).csv(path), path, hint)
    else:
        df = _guard(lambda: spark.read.format(fmt).load(path), path, hint)
    if reference_names if reference_names is not None else fmt == "csv":
        df = from_reference_names(df)
    for c in ("start_ts", "end_ts", "event_ts"):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, parse_ts_strict(c, ntz=ntz, what=c) if strict else parse_ts_lenient(c, ntz=ntz))
    if "event_ts" not in df.columns:
        df = df.withColumn("event_ts", F.col("start_ts"))
    if "event_id" in df.columns and dict(df.dtypes)["event_id"] == "string":
        df = df.withColumn("event_id", F.expr("try_cast(event_id AS bigint)"))     # ties sort as numbers
    if "event_id" not in df.columns:
        df = df.withColumn("event_id", F.monotonically_increasing_id())
    return df.na.drop(subset=["case_id", "activity", "start_ts", "end_ts"])


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver fixture ``events`` as a canonical log.

    case = user_id, activity = event_type, start = ts,
    end = ts + value minutes rounded to the microsecond.
    """
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    dur_us = F.round(F.col("value") * F.lit(60_000_000)).cast("bigint")
    return ev.select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("start_ts"),
        F.timestamp_add("MICROSECOND", dur_us, F.col("ts")).alias("end_ts"),
        F.col("ts").alias("event_ts"),
        F.col("event_id"),
    )


def to_reference_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in REFERENCE_NAMES.items() if k in df.columns})


def from_reference_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in REFERENCE_NAMES.items() if v in df.columns})


def _writer(df: DataFrame, mode: str):
    return df.write.mode(mode)


def write_log(log: DataFrame, path: str, fmt: str = "parquet", n_files: int | None = None,
              mode: str = "overwrite") -> str:
    """Persist a log range-partitioned and sorted by (case, start, end, event).

    Range partitioning splits even a single huge case across files, and each
    file is internally sorted -- no global single-task sort.
    """
    keys = ["case_id", "start_ts", "end_ts", "event_id"]
    keys = [k for k in keys if k in log.columns]
    out = log.repartitionByRange(n_files, *keys) if n_files else log.repartitionByRange(*keys)
    out = out.sortWithinPartitions(*keys)
    if fmt == "csv":
        # Spark's own formats end at milliseconds.
        csv_options(_writer(to_reference_names(out), mode)).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option(
            "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    else:
        _writer(out, mode).format(fmt).save(path)
    return path


def write_dated_log(log: DataFrame, path: str, n_files: int | None = None, mode: str = "overwrite") -> str:
    """Persist a log as Parquet in one folder per start date, sorted by (case, start, end, event) in each file.

    Rows are range-partitioned by date and then by those keys: a file holds rows of one date,
    and a date with very many rows is split over several tasks (``n_files``, by default
    what adaptive execution takes for the bytes) and files.  The date of a zone-aware start is that of the session zone; rows without a start have a folder of their own.
    """
    keys = [k for k in ("case_id", "start_ts", "end_ts", "event_id") if k in log.columns]
    dated = log.withColumn(DATE_COLUMN, F.to_date("start_ts"))
    out = dated.repartitionByRange(*([n_files] if n_files else []), DATE_COLUMN, *keys).sortWithinPartitions(DATE_COLUMN, *keys)
    out.write.mode(mode).partitionBy(DATE_COLUMN).parquet(path)
    return path


def read_dated_log(spark: SparkSession, path: str, first=None, last=None, week: str | None = None, day_types=None,
                   region: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A log of :func:`write_dated_log`: between two dates (both included), of one week label, of some day types.

    All filters are expressions of the date alone, so folders of other dates are not read; each
    filter leaves out rows without a date.  ``day_types`` are names of ``DAY_TYPES``, holidays those of
    ``region``.  ``schema`` (columns of the log, without the date) is needed for a log without rows only.
    """
    reader = spark.read.schema(StructType([*schema.fields, StructField(DATE_COLUMN, DateType())])) if schema else spark.read
    log = _guard(lambda: reader.parquet(path), path)
    date = F.col(DATE_COLUMN).cast("date")
    if first is not None:
        log = log.filter(date >= F.lit(first).cast("date"))
    if last is not None:
        log = log.filter(date <= F.lit(last).cast("date"))
    if week is not None:
        log = log.filter(date.isNotNull() & (year_week(date) == week))
    if day_types is not None:
        unknown = set(day_types) - set(DAY_TYPES)
        if unknown:
            raise ValueError(f"unknown day types: {sorted(unknown)}")
        log = log.filter(date.isNotNull() & day_type(is_holiday(date, region), is_weekend(date), DAY_TYPES).isin(list(day_types)))
    return log.withColumn(DATE_COLUMN, date)


def write_transitions(trans: DataFrame, path: str, mode: str = "overwrite",
                      reference_names: bool = True, reference_text: bool = True) -> str:
    """The fixed 12-column transition report as CSV with a header.

    With ``reference_text`` the cells look like the process-mining report:
    timestamps ``yyyy-MM-dd HH:mm:ss+00:00`` (UTC offset; fractions of a
    second only when present), dates ``yyyy-MM-dd``, booleans ``True``/``False``.
    """
    out = trans.select(*TRANSITION_COLUMNS)
    if reference_text:
        def ts_text(c):
            t = F.col(c)
            if dict(out.dtypes)[c] == "timestamp":          # the instant as UTC wall time, whatever the session zone
                t = F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))
            base = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
            frac = F.date_format(t, "SSSSSS")
            return F.concat(base, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                            F.lit("+00:00"))
        cols = []
        for c, dt in out.dtypes:
            if dt in ("timestamp", "timestamp_ntz"):
                cols.append(ts_text(c).alias(c))
            elif dt == "boolean":
                cols.append(F.when(F.col(c), F.lit("True")).when(~F.col(c), F.lit("False")).alias(c))
            elif dt == "date":
                cols.append(F.date_format(F.col(c), "yyyy-MM-dd").alias(c))
            else:
                cols.append(F.col(c))
        out = out.select(*cols)
    if reference_names:
        out = to_reference_names(out).withColumnRenamed("start_date", "date")
    csv_options(_writer(out, mode)).csv(path)
    return path


def read_features(spark: SparkSession, store_dir: str, name: str = "encounter_features.parquet") -> DataFrame:
    """Feature-store source: the table that ``write_features`` left in ``store_dir``."""
    path = f"{store_dir.rstrip('/')}/{name}"
    return _guard(lambda: spark.read.parquet(path), path, "Were the features built first?")


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Feature-store sink (Parquet); returns the path written."""
    _writer(features, mode).parquet(path)
    return path
