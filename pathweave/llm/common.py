"""Helpers shared by the corpus operators: column picking, table reading, shared intermediate tables."""

from __future__ import annotations

import contextlib
import functools
import gc
import os
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.session import shared_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; ``sf_dir`` may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types.

    Columns are found by exact name (the first one, if a name is repeated) and by
    position, so further columns whose names clash, also those that differ only in
    case, do no harm.
    """
    at = {name: df.columns.index(name) for name in types}
    return _positional(df).select(*[F.col(f"_c{i}").cast(types[n]).alias(n) for n, i in at.items()])


class Carried:
    """All columns of a table under positional names, so that nothing clashes while a stage works.

    ``frame`` has the columns ``_c0`` ... and is joined or filtered; ``back`` gives
    the table its own names and order again.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.types = [f.dataType for f in df.schema.fields]
        self.frame = _positional(df)

    def col(self, name: str) -> Column:
        return F.col(f"_c{self.names.index(name)}")

    def back(self, df: DataFrame, **changed: Column) -> DataFrame:
        cols = [F.col(f"_c{i}") for i in range(len(self.names))]
        for name, c in changed.items():
            if name in self.names:
                i = self.names.index(name)
                cols[i] = c.cast(self.types[i])
        return df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cols)]).toDF(*self.names)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the folder of ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: what is read again survives lost executors, and work
    that several branches need is done once.  Shuffle files of the write go with it,
    and ``drop_tables`` deletes the table when no plan reads it any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a query of this block when the query ends, not when the driver collects garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``shared_table`` (the frames that it returned, not frames made of them); only for tables that no plan reads any more."""
    for table in tables:
        path = _written.pop(table)
        at = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


FILTER_BITS = 26             # hashes in question are remembered in a bitmap of 8 MB


def hash_bitmap(hashes: DataFrame) -> np.ndarray:
    """The first bits of the hashes (one bigint column) as a bitmap: 2**(FILTER_BITS - 5) words at most, however many hashes there are."""
    at = F.shiftrightunsigned(hashes.columns[0], 64 - FILTER_BITS)
    words = hashes.select(at.alias("at")).select(
        F.shiftright("at", 5).alias("w"), F.expr("shiftleft(1L, CAST(at & 31 AS INT))").alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()          # 12 bytes a word on the driver
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return bits.view(np.uint8)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64 or uint64) have their bit set: all that are in the bitmap, and a few others."""
    at = hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def likely_in(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of bigint columns by ``in_bitmap``: what fails it is not among the hashes (one bigint column).

    Rows with long texts that fail it need no join, and so no shuffle; only their hashes go to Python.
    """
    _package_on_workers(hashes.sparkSession)
    bits = hashes.sparkSession.sparkContext.broadcast(hash_bitmap(hashes))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, h.to_numpy(np.int64)))
    return test


SLICE_ROWS = 1000            # rows of a batch that a stage turns into Python objects at once


def _package_on_workers(spark: SparkSession) -> None:
    """Put the folder of this package on the path of workers that see the driver's folders; elsewhere it is not looked at."""
    env = spark.sparkContext.environment
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])


def map_arrow(df: DataFrame, stage: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(stage, schema)``, with the folder of this package on the workers' path.

    A stage gets its batches in slices, so that its memory does not depend on the session's batch size.

    That serves workers that see the driver's folders; elsewhere the package is
    shipped with ``--py-files`` and the extra folder is not looked at.
    """
    _package_on_workers(df.sparkSession)

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)

    def run(batches):
        try:
            yield from stage(sliced(batches))
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give what a stage no longer needs back to the system; workers live on for the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):             # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def nullable(schema: T.StructType) -> T.StructType:
    """The same columns, all nullable, so that batches fit whatever Spark knew of nulls."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def without_cycles(stage: Callable) -> Callable:
    """A stage that makes very many small objects and no reference cycles: it runs without the search for cycles."""
    @functools.wraps(stage)
    def run(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from stage(batches)
        finally:
            if was:
                gc.enable()
    return run
