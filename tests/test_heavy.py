"""Top labels among very many, against the plain count."""

import pytest
from pyspark.sql import functions as F

from pathweave.operators import features, heavy


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def log(spark):
    """30,000 rows, 9,000 labels: a few frequent ones, many ties, one null label, padded text."""
    n = F.col("id")
    label = F.when(n < 12_000, F.concat(F.lit(" head "), F.floor(F.sqrt(n % 400)).cast("string"))).when(n < 12_500, F.lit(None)).otherwise(
        F.concat(F.lit("tail "), (n % 9000).cast("string"), F.lit(" ")))
    return spark.range(30_000).select(label.alias("activity"))


@pytest.mark.parametrize("buckets", [1, 5, 64, 1 << 16])
@pytest.mark.parametrize("k", [1, 7, 30])
def test_equal_to_the_plain_count(log, buckets, k):
    assert pairs(heavy.heavy_hitters(log, k, buckets=buckets)) == pairs(features.top_activities(log, k))


def test_few_labels_are_counted_one_by_one(log):
    every = log.distinct().count()
    counted = heavy.candidates(log, 10, buckets=1 << 14).distinct().count()
    assert 10 <= counted < every / 50


def test_even_counts_are_all_counted(spark):
    even = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("activity"))
    assert heavy.candidates(even, 3, buckets=256).distinct().count() == 1000
    assert pairs(heavy.heavy_hitters(even, 3, buckets=256)) == [("0", 2), ("1", 2), ("10", 2)]


def test_fewer_labels_than_asked_empty_log_and_wrong_k(spark, log):
    few = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "activity string")
    assert pairs(heavy.heavy_hitters(few, 10)) == pairs(features.top_activities(few, 10))
    assert pairs(heavy.heavy_hitters(few.limit(0), 10)) == []
    with pytest.raises(ValueError):
        heavy.heavy_hitters(few, 0)
