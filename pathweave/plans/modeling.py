"""Duration models with Spark ML: rows, splits, boosted trees, MAE, scoring, persistence."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.timefns import minutes_between, round2
from pathweave.functions.encode import multi_hot
from pathweave.operators.stats import group_quantiles

# Boosted-tree settings (100 trees, learning rate 0.1, depth 5, seed 42)
# and the default split (20 % held out, seed 42).
GBT_PARAMS = dict(maxIter=100, stepSize=0.1, maxDepth=5, seed=42)
TEST_FRACTION = 0.2
SEED = 42
CALENDAR_FEATURES = ["Day_Index", "Arrival_Hour"]


def training_rows(log: DataFrame) -> DataFrame:
    """Service minutes (>= 0 kept) with weekday index and arrival hour as features."""
    st = F.col("start_ts")
    return (log.select("event_id", st, F.col("end_ts"),
                       minutes_between(st, F.col("end_ts")).alias("Waiting_Time_Mins"),
                       F.weekday(st).alias("Day_Index"), F.hour(st).alias("Arrival_Hour"))
            .filter(F.col("Waiting_Time_Mins") >= 0))


def training_table_from_raw(spark, path: str, sep: str = ";", multiline: bool = False) -> DataFrame:
    """Raw delimited log -> training rows: stripped headers, lenient START/STOP,
    rows missing either time dropped, service minutes >= 0, calendar features."""
    from pathweave.functions.timefns import parse_ts_lenient
    from pathweave.sources.eventlog import read_csv_stripped
    raw = read_csv_stripped(spark, path, sep, multiline)
    df = raw.select(F.xxhash64(*[F.col(c) for c in raw.columns]).alias("event_id"),
                    parse_ts_lenient("START").alias("start_ts"), parse_ts_lenient("STOP").alias("end_ts"))
    return training_rows(df.na.drop(subset=["start_ts", "end_ts"]))


def random_split_flag(df: DataFrame, id_col: str = "event_id", test_fraction: float = TEST_FRACTION,
                      seed: int = SEED) -> DataFrame:
    """Deterministic split: a row is held out when its bucket falls in the test share.

    The bucket comes from the MD5 checksum of "<seed>:<id>" as text, so any
    engine gives the same split; unlike ``randomSplit`` it does not depend on
    partitioning or row order.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), 1, 10)
    bucket = F.conv(digits, 16, 10).cast("bigint") % F.lit(1_000_000)
    return df.withColumn("split", F.when(bucket < F.lit(int(round((1 - test_fraction) * 1_000_000))),
                                         F.lit("train")).otherwise(F.lit("test")))


def chrono_split_flag(df: DataFrame, time_col: str, val_fraction: float = 0.25) -> DataFrame:
    """Newest ``val_fraction`` to validation: cut = (1 - f) quantile of the time; train <= cut < val.

    The cut is a one-row aggregate (exact quantile)
    cross-joined back; nothing is collected.
    """
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                          F.col(time_col).cast("timestamp_ntz"))
    cut = group_quantiles(df.select(us.alias("value")), (), [1.0 - val_fraction]).select(F.col("_q")[0].alias("_cut"))
    return (df.crossJoin(F.broadcast(cut))
            .withColumn("split", F.when(us <= F.col("_cut"), F.lit("train")).otherwise(F.lit("val")))
            .drop("_cut"))


def split_frames(flagged: DataFrame, first: str = "train", second: str = "val"):
    return (flagged.filter(F.col("split") == first).drop("split"),
            flagged.filter(F.col("split") == second).drop("split"))


def gbt_pipeline(feature_cols, label: str, params: dict | None = None, weight_col: str | None = None) -> Pipeline:
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction",
                       **(params or GBT_PARAMS))
    return Pipeline(stages=[asm, gbt.setWeightCol(weight_col) if weight_col else gbt])


def train(train_df: DataFrame, label: str, feature_cols=None, params: dict | None = None,
          weight_col: str | None = None) -> PipelineModel:
    feature_cols = feature_cols or [c for c in train_df.columns if c.startswith("proc_count__")]
    data = train_df.withColumn(label, F.col(label).cast("double"))
    return gbt_pipeline(feature_cols, label, params, weight_col).fit(data)


def train_on_vectors(rows: DataFrame, label: str, params: dict | None = None, weight_col: str | None = None) -> PipelineModel:
    """The model that ``train`` fits, from a vector column ``features`` (``sparse.sparse_case_features``)."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", **(params or GBT_PARAMS))
    stages = [gbt.setWeightCol(weight_col) if weight_col else gbt]
    return Pipeline(stages=stages).fit(rows.withColumn(label, F.col(label).cast("double")))


def cells(rows: DataFrame, label: str, feature_cols) -> DataFrame:
    """One row for each combination of features: the mean label, and ``rows`` of it.

    A tree sees nothing else of the rows: sums of labels decide its splits and leaves, and what labels differ
    within a combination adds the same to every split.
    """
    return rows.groupBy(*feature_cols).agg(F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("rows"))


def train_on_cells(rows: DataFrame, label: str, feature_cols, params: dict | None = None) -> PipelineModel:
    """The model that ``train`` fits, from weighted cells: its cost follows the combinations of features, not the rows.

    The cells are written once to the shared folder, as every tree reads them several times.
    """
    from pathweave.operators.stats import materialize
    return train(materialize(cells(rows, label, feature_cols), "cells"), label, feature_cols, params, weight_col="rows")


def first_split(model: PipelineModel, feature_cols) -> tuple[str, float] | None:
    """Feature and threshold of the root of the first tree; None if it is a leaf."""
    root = model.stages[-1].trees[0]._call_java("rootNode")
    if root.numDescendants() == 0:
        return None
    return list(feature_cols)[root.split().featureIndex()], root.split().threshold()


def mae_of(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"))


def evaluate(model, df: DataFrame, label: str) -> dict:
    """{'mae': ...} -- one aggregate, one row to the driver."""
    return {"mae": mae_of(model.transform(df), label).first()["mae"]}


def score(model, df: DataFrame, out: str = "predicted_min") -> DataFrame:
    """Batch scoring over a table; prediction rounded to 2 decimals (numpy style)."""
    return model.transform(df).withColumn(out, round2(F.col("prediction"))).drop("features", "prediction")


def predict_minutes(model, lists: DataFrame, vocabulary, items: str = "procedures", keep=()) -> DataFrame:
    """Lists of procedures -> 0/1 vector over the vocabulary -> model -> minutes rounded to 2 decimals."""
    return score(model, lists.select(*keep, *multi_hot(items, vocabulary))).select(*keep, "predicted_min")


def save_artifacts(model_dir: str, model, metrics: dict) -> dict:
    """Model via the ML writer, metrics as a one-line JSON next to it; returns the paths."""
    mpath = os.path.join(model_dir, "model")
    model.write().overwrite().save(mpath)
    ss = SparkSession.getActiveSession()
    jpath = os.path.join(model_dir, "metrics.json")
    ss.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(jpath)
    return {"model": mpath, "metrics": jpath}


def load_model(model_dir: str) -> PipelineModel:
    mpath = os.path.join(model_dir, "model")
    try:
        return PipelineModel.load(mpath)
    except Exception as e:  # missing or unreadable artefact
        raise FileNotFoundError(f"model not found at {mpath}. Was training run first?") from e


@dataclass
class Trainer:
    """load -> split -> train -> evaluate -> save, each step replaceable."""
    load: object
    model_dir: str
    label: str = "encounter_duration_minutes"
    time_col: str = "encounter_start"
    val_fraction: float = 0.25
    params: dict = field(default_factory=lambda: dict(GBT_PARAMS))

    def run(self) -> dict:
        df = self.load()
        tr, va = split_frames(chrono_split_flag(df, self.time_col, self.val_fraction))
        model = train(tr, self.label, params=self.params)
        metrics = evaluate(model, va, self.label)
        return save_artifacts(self.model_dir, model, metrics)
