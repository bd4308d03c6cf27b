"""Incremental (Structured Streaming) cleaning of raw log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pathweave.operators.clean import ingest_raw
from pathweave.session import shared_path
from pathweave.sources.eventlog import csv_options

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True)
                           for c in ("ENCOUNTER", "START", "STOP", "DESCRIPTION")])


def clean_stream(spark: SparkSession, path: str, sep: str = ";", schema: T.StructType = RAW_SCHEMA,
                 ntz: bool = False, max_files_per_trigger: int | None = None, multiline: bool = False) -> DataFrame:
    """Streaming DataFrame of canonical rows from raw delimited files arriving under ``path``."""
    r = csv_options(spark.readStream.schema(schema), multiline).option("sep", sep)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.csv(path)
    # The tie-break id must be stable across restarts: derive it from the row, not from position.
    from pyspark.sql import functions as F
    raw = raw.withColumn("_rid", F.xxhash64(*[F.col(c) for c in schema.fieldNames()]))
    return ingest_raw(raw, ntz=ntz, id_col="_rid")


def write_clean_stream(sdf: DataFrame, out_path: str, checkpoint: str | None = None,
                       trigger_once: bool = True):
    """Append cleaned rows as Parquet; progress kept in the shared checkpoint folder."""
    ckpt = checkpoint or shared_path(sdf.sparkSession, "stream-clean-log")
    w = (sdf.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
