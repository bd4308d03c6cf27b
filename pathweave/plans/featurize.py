"""Event log -> per-case feature table -> feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathweave.operators.features import case_features
from pathweave.sources.eventlog import read_log, write_features

FEATURES_NAME = "encounter_features.parquet"


def build_features(spark: SparkSession, log_path: str, store_dir: str, fmt: str = "csv",
                   top_k: int = 50) -> str:
    """Load the processed log, build duration + activity-count features, write Parquet; return the path."""
    log = read_log(spark, log_path, fmt=fmt)
    feats = case_features(log, k=top_k)
    return write_features(feats, f"{store_dir.rstrip('/')}/{FEATURES_NAME}")
