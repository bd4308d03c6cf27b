"""A log in buckets by case, so that plans by case need no exchange.

The rows of a case share a bucket, and a scan gives one bucket to one task: windows and aggregations by
``case_id`` start right there.  The files are written in ranges of (bucket, case, start, end, event),
so a case with very many rows is written by several tasks and lies in several files.  Next to the
log stands one row with the schema, the number of buckets and the rows of the largest case; traces take that
size from there instead of counting, and where it makes a case hot the log is split as any other.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathweave.operators.trace import ORDER, CaseSizes
from pathweave.sources.eventlog import _guard


class BucketedLog(NamedTuple):
    log: DataFrame
    sizes: CaseSizes
    n_buckets: int


def _table_name() -> str:
    return f"pathweave_log_{uuid.uuid4().hex}"


def write_bucketed_log(log: DataFrame, path: str, n_buckets: int | None = None, n_files: int | None = None) -> str:
    """Persist a log as Parquet in ``n_buckets`` buckets by case, each file sorted by (case, start, end, event).

    ``n_buckets`` is that of ``spark.sql.shuffle.partitions`` by default; choose it for the log's bytes, for it bounds the
    tasks of a scan by buckets.  ``n_files`` is the number of writing tasks, by default what adaptive execution takes.  What
    ``path`` held is overwritten.  Rows without a case share one bucket.
    """
    spark = log.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["case_id", *[k for k in ORDER if k in log.columns]]
    bucket = F.pmod(F.hash("case_id"), F.lit(n_buckets))           # as Spark's own writer numbers them
    ranged = log.repartitionByRange(*([n_files] if n_files else []), bucket, *keys)
    name = _table_name()
    ranged.write.mode("overwrite").format("parquet").option("path", f"{path}/log").bucketBy(n_buckets, "case_id").sortBy(*keys).saveAsTable(name)
    sizes = spark.table(name).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_case"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    sizes.select("*", F.lit(n_buckets).alias("n_buckets"), F.lit(log.schema.json()).alias("schema")).write.mode("overwrite").json(f"{path}/sizes")
    spark.sql(f"DROP TABLE {name}")                                # the files stay, for the table named its own path
    return path


def read_bucketed_log(spark: SparkSession, path: str, table: str | None = None) -> BucketedLog:
    """The log that ``write_bucketed_log`` left at ``path``, also one of another session, and its sizes.

    It is registered in the session's catalog under ``table`` (a new name by default), since Spark knows of buckets by
    a table only; with a persistent catalog, drop the table when it is no longer needed.
    """
    sizes = _guard(lambda: spark.read.schema("largest_case bigint, rows bigint, n_buckets int, schema string").json(f"{path}/sizes"), path).first()
    schema = StructType.fromJson(json.loads(sizes["schema"]))
    columns = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema.fields)
    keys = ", ".join(["case_id", *[k for k in ORDER if k in schema.names]])
    place = f"{path}/log".replace("\\", "\\\\").replace("'", "\\'")
    name = table or _table_name()
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (case_id) SORTED BY ({keys}) "
              f"INTO {sizes['n_buckets']} BUCKETS LOCATION '{place}'")
    return BucketedLog(spark.table(name), CaseSizes(sizes["largest_case"], sizes["rows"]), sizes["n_buckets"])
