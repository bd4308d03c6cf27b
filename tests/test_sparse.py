"""Sparse case features against the dense columns, and models trained on them."""

import pytest
from pyspark.sql import functions as F

from pathweave.operators import features, sparse
from pathweave.plans import modeling
from pathweave.sources import events_as_log

from conftest import SF_SMALL

HEAD = ["case_id", "encounter_start", "encounter_end", "event_count", "encounter_duration_minutes", "total_hours"]
FEW_TREES = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.1, "seed": 42}


@pytest.mark.parametrize("k", [3, 50])
def test_vectors_equal_the_dense_columns(spark, k):
    log = events_as_log(spark, SF_SMALL).withColumn("activity", F.concat(F.lit(" "), "activity"))
    log = log.unionByName(log.limit(3).withColumn("activity", F.lit(None).cast("string")))
    names = features.top_activity_list(log.filter("activity IS NOT NULL"), k)
    dense = features.case_features(log, names=names)
    columns = dense.columns[len(HEAD):]
    index = sparse.activity_index(log, k)
    assert [r.activity for r in index.orderBy("idx").collect()] == sorted(names)
    got = {r.case_id: r for r in sparse.sparse_case_features(log, index).collect()}
    want = dense.collect()
    assert len(got) == len(want)
    for row in want:
        assert [got[row.case_id][c] for c in HEAD] == [row[c] for c in HEAD]
        vector = got[row.case_id].features
        assert vector.toArray().tolist() == [row[c] for c in columns]
        assert len(vector.indices) == sum(row[c] > 0 for c in columns)


def test_models_of_both_forms_predict_the_same(spark):
    log = events_as_log(spark, SF_SMALL)
    label = "encounter_duration_minutes"
    dense = features.case_features(log, 50).orderBy("case_id").coalesce(1)
    vectors = sparse.sparse_case_features(log, sparse.activity_index(log)).orderBy("case_id").coalesce(1)
    a = modeling.score(modeling.train(dense, label, params=FEW_TREES), dense)
    b = modeling.score(modeling.train_on_vectors(vectors, label, FEW_TREES), vectors)
    assert [tuple(r) for r in a.select("case_id", "predicted_min").orderBy("case_id").collect()] == \
        [tuple(r) for r in b.select("case_id", "predicted_min").orderBy("case_id").collect()]


def test_five_thousand_activities_train(spark):
    log = spark.range(24_000).select(
        (F.col("id") % 400).alias("case_id"), F.concat(F.lit("proc "), F.col("id") % 6007).alias("activity"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("start_ts"),
        F.timestamp_add("MINUTE", F.lit(10) + (F.col("id") % 400).cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("end_ts"))
    vectors = sparse.sparse_case_features(log, sparse.activity_index(log, 5000))
    first = vectors.first().features
    assert first.size == 5000 and len(first.indices) <= 60
    model = modeling.train_on_vectors(vectors, "encounter_duration_minutes", {**FEW_TREES, "maxIter": 1, "maxDepth": 1})
    assert modeling.score(model, vectors).filter("predicted_min > 0").count() == 400


def test_no_rows_and_no_indexed_activity(spark):
    log = events_as_log(spark, SF_SMALL)
    index = sparse.activity_index(log, 2)
    assert sparse.sparse_case_features(log.limit(0), index).count() == 0
    assert sparse.activity_index(log.limit(0)).count() == 0
    other = log.withColumn("activity", F.lit("something else"))
    rows = sparse.sparse_case_features(other, index).collect()
    assert rows and all(r.features.size == 2 and len(r.features.indices) == 0 for r in rows)
