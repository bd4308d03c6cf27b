"""What the operators and stages leave on disk and how much they shuffle."""

import hashlib
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.llm import ngram_join, substring_dedup
from pathweave.llm.common import drop_tables, hash_bitmap, in_bitmap, likely_in, shared_table
from pathweave.session import shared_path


def _tables(spark):
    folder = shared_path(spark, "llm").removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: os.path.getsize(os.path.join(d, f)) for top in local for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def _docs(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(hashlib.md5(b"%d %d" % (i, j)).hexdigest() for j in range(200)) + ".", "en", "h", 1000) for i in range(60)]
    rows += [(100 + i, " ".join([*words[:60 - i], f"x{i}", *words[60 - i:]]) + ".", "en", "h", 600) for i in range(9)]    # near copies
    passage = " ".join(f"p{i}" for i in range(40)) + "."
    rows += [(200 + i, f"only {i} here. {passage} and {i} there.", "en", "h", 100) for i in range(5)]
    rows += [(None, None, None, None, None), (None, "a text without a number", None, None, None), (300, "", "en", "h", 0)]
    path = f"{shared_path(spark, 'disk')}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("stage", "left"), [(ngram_join.keep_one, "judged-"), (substring_dedup.remove_repeats, "runs-")])
def test_a_stage_leaves_only_the_table_that_its_result_reads(spark, stage, left):
    docs = _docs(spark)
    before = _tables(spark)
    result = stage(spark, docs, "")
    new = _tables(spark) - before
    assert len(new) == 1 and new.pop().startswith(left)
    assert result.count() == (65 if stage is ngram_join.keep_one else 77)
    assert result.count() == (65 if stage is ngram_join.keep_one else 77)                 # it can be read again


def test_queries_can_be_read_after_their_tables_are_dropped(spark):
    docs = _docs(spark)
    links = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    assert links[100] == 8 and links[0] == links[200] == 0
    found, pairs = ngram_join.all_links(docs)
    assert found.count() == 77 and pairs.count() == 9 * 8 // 2
    assert {r.doc_id for r in substring_dedup.repeated_runs(docs).collect()} == {201, 202, 203, 204}


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffle_files(spark)
    table = shared_table(spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    assert not set(_shuffle_files(spark)) - set(before)
    assert table.count() == 700
    path = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    drop_tables(table)
    assert not os.path.exists(path)


@pytest.mark.parametrize("stage", [ngram_join.keep_one, substring_dedup.remove_repeats])
def test_texts_without_a_verdict_are_not_shuffled(spark, stage):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")             # as with a large table of verdicts
    try:
        result = stage(spark, _docs(spark), "")
        before = _shuffle_files(spark)
        result.write.parquet(f"{shared_path(spark, 'disk')}/{uuid.uuid4().hex}")
        new = sum(size for f, size in _shuffle_files(spark).items() if f not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert 0 < new < 60 * 200 * 33 // 5                                      # a fraction of the 60 texts of their own


def test_bitmap_keeps_all_that_are_in_it(spark):
    hashes = spark.range(0, 3000).select(F.xxhash64("id").alias("h"))
    inside = np.array([r.h for r in hashes.collect()], np.int64)
    bits = hash_bitmap(hashes)
    assert in_bitmap(bits, inside).all()
    other = spark.range(10_000, 40_000).select(F.xxhash64("id").alias("h"))
    test = likely_in(hashes)
    assert hashes.filter(test("h")).count() == 3000 and other.filter(test("h")).count() < 30
    assert not in_bitmap(hash_bitmap(hashes.filter("h != h")), inside).any()
