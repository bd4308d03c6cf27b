"""Balanced contiguous shards from global byte-size prefix sums.

Rows are put in order of ``doc_id``, range-partitioned and given a running sum within
each partition; the totals of the partitions (one row each) give every partition's
offset.  The global prefix sum is cut at equal targets, so shard ``s`` holds the rows
whose first byte lies in the s-th of ``n`` equal parts of the corpus.

Only (id, size, checksum) rows are shuffled, 24 bytes each, never the texts.  No task
sees more than one range partition, and equal ids are split over partitions by a row
number, so neither a hot id nor many equal texts make a large task.

Defined cases: null text counts as 0 bytes (size 1, checksum of the empty string);
rows with a null id come first; equal ids are ordered by checksum, then size, and
identical rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import Carried, pick, shared_table

LAW = "bytes"


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return pick(docs, doc_id="bigint", text="string").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to n-1) and slot (gapless from 0 within the shard)."""
    return _placed(_slim(docs).withColumn("row", F.monotonically_increasing_id()), n_shards).drop("row")


def _placed(slim: DataFrame, n_shards: int) -> DataFrame:
    """Shard and slot of rows that have a number of their own (``row``)."""
    spark = slim.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("row").asc()]
    n_part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared_table(slim.repartitionByRange(n_part, *order).withColumn("part", F.spark_partition_id()), "ranges")
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", F.sum("size").over(run).alias("sum_to"), F.row_number().over(
        Window.partitionBy("part").orderBy(*order)).cast("bigint").alias("rank"))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    # One row per range partition: the offsets of a few hundred to a few hundred thousand partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
                            F.sum("part_bytes").over(everything).alias("all_bytes"))
    placed = local.join(F.broadcast(offsets), "part").select(
        "row", "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rank") - 1).alias("at"),
        F.expr(f"((bytes_before + sum_to - size) * {int(n_shards)}L) div all_bytes").cast("int").alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first_at"))          # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "row", "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first_at")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write whole documents to ``path/shard=<s>/``, each row to the shard of its own place, equal rows too.

    Rows are written with a number once, so that assignment and files speak of the same rows.
    """
    kept = Carried(docs)
    numbered = shared_table(kept.frame.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    text = F.coalesce(kept.col("text").cast("string"), F.lit("")).cast("binary")
    slim = numbered.select(kept.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                           F.crc32(text).alias("text_crc32"), F.col("_row").alias("row"))
    placed = _placed(slim, n_shards).select(F.col("row").alias("_row"), F.col("shard").alias("_shard"))
    joined = numbered.join(placed, "_row")
    out = joined.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(kept.names)], F.col("_shard").alias("shard"))
    out.write.partitionBy("shard").parquet(path)
