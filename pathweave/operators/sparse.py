"""Case features over many activities: one sparse vector per case instead of one column per activity.

The counts come from one aggregation by (case, activity), whatever the number of activities; a case
with very many rows is spread by its activities, and what meets per case is one entry for each
activity that the index has.
"""

from __future__ import annotations

import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pathweave.functions.timefns import minutes_between
from pathweave.operators.features import _trimmed, top_activities
from pathweave.operators.stats import materialize
from pathweave.session import shared_path


def activity_index(log: DataFrame, k: int = 50, col: str = "activity") -> DataFrame:
    """(activity, idx) of the ``k`` most frequent activities, idx from 0 in alphabetical order; written once.

    Numbering puts these at most ``k`` rows in one task.  Null activities have no index.
    """
    top = top_activities(log.filter(F.col(col).isNotNull()), k, col)
    place = F.row_number().over(Window.orderBy(col)) - 1
    return materialize(top.select(F.col(col).alias("activity"), place.alias("idx")), "activity-index")


def sparse_case_features(log: DataFrame, index: DataFrame, case_col: str = "case_id") -> DataFrame:
    """The columns of ``case_features``, the counts as one vector ``features`` in the order of ``index``; written once.

    Cases without any indexed activity have a vector without entries, cases whose duration is not
    positive are left out, and an empty log gives no rows.
    """
    size = index.count()
    coded = _trimmed(log).join(index, "activity", "left")
    cells = coded.groupBy(case_col, "idx").agg(F.min("start_ts").alias("first"), F.max("end_ts").alias("last"),
                                               F.count("activity").alias("named"), F.count(F.lit(1)).cast("double").alias("n"))
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "n"))
    cases = cells.groupBy(case_col).agg(F.min("first").alias("encounter_start"), F.max("last").alias("encounter_end"),
                                        F.sum("named").alias("event_count"), F.array_sort(F.collect_list(entry)).alias("entries"))
    minutes = F.col("encounter_duration_minutes")
    cases = cases.withColumn("encounter_duration_minutes", minutes_between("encounter_start", "encounter_end")).filter(minutes > 0)
    # The stored form of a sparse vector; read again, it is one.
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("entries.idx").alias("indices"),
                      F.col("entries.n").alias("values"))
    cases = cases.select(case_col, "encounter_start", "encounter_end", "event_count", minutes, (minutes / 60.0).alias("total_hours"),
                         vector.alias("features"))
    spark = log.sparkSession
    path = shared_path(spark, f"sparse-features-{uuid.uuid4().hex}")
    cases.write.parquet(path)
    fields = [StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in cases.schema.fields]
    return spark.read.schema(StructType(fields)).parquet(path)
