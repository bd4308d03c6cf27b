"""Top labels among very many: a table of counts by hash bounds the labels that are counted one by one.

A plain count ships every different label of every task.  Here tasks ship one count for each of ``BUCKETS``
hashes.  A label is at most as frequent as its bucket, so no label of a bucket below the k-th greatest count can be
among the top k; a lower bound of that count comes from the labels of the k fullest buckets, counted
exactly.  Only labels of the buckets that reach it are counted.  The result is exact for any data: where the
counts are so even that every bucket reaches the bound, all labels are counted.  For few labels
``features.top_activities`` reads the log once instead of three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.features import _trimmed
from pathweave.operators.stats import materialize

BUCKETS = 1 << 16            # rows of the table, and of what is broadcast, at most


def _of_buckets(names: DataFrame, kept: DataFrame) -> DataFrame:
    """The labels (with repeats) of the kept buckets; ``kept`` has at most ``buckets`` numbers."""
    return names.join(F.broadcast(kept.select("bucket")), "bucket", "left_semi")


def candidates(log: DataFrame, k: int, col: str = "activity", buckets: int = BUCKETS) -> DataFrame:
    """Every row (label only, trimmed) whose label may be among the top ``k``, also all rows of labels equally frequent."""
    names = _trimmed(log, col).select(col).withColumn("bucket", F.pmod(F.xxhash64(col), F.lit(buckets)))
    totals = materialize(names.groupBy("bucket").agg(F.count(F.lit(1)).alias("total")), "label-buckets")
    fullest = totals.orderBy(F.col("total").desc(), "bucket").limit(k)
    known = _of_buckets(names, fullest).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc()).limit(k)
    found = known.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("labels")).first()        # one row
    least = found["least"] if found["labels"] == k else 0
    return _of_buckets(names, totals.filter(F.col("total") >= F.lit(least))).select(col)


def heavy_hitters(log: DataFrame, k: int = 50, col: str = "activity", buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``features.top_activities`` (label, n; ties by name, nulls are one label) for logs of very many labels."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return (candidates(log, k, col, buckets).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col).asc()).limit(k))
