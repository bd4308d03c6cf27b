"""Connected components of an edge table by alternating star operations.

Every step is an aggregation and a join on node ids, written to the shared folder; no
node's neighbours are gathered in one place, and the number of steps grows with the
logarithm of the longest path.  A node with very many edges is pre-aggregated by each
task, and as a join key both of whose sides are shuffled it is split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import drop_tables, shared_table

MAX_STEPS = 60


def _minima(pairs: DataFrame) -> DataFrame:
    return shared_table(pairs.groupBy("u").agg(F.min("v").alias("m"))
                        .select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star-minima")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    minima = _minima(both)
    joined = both.join(minima, F.col("u") == F.col("k"))
    out = shared_table(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large-star")
    drop_tables(minima)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = _minima(down)
    joined = down.join(minima, F.col("u") == F.col("k"))
    own = minima.select(F.col("k").alias("u"), F.col("m").alias("v"))
    out = shared_table(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).filter("u != v").distinct(), "small-star")
    drop_tables(minima)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b), as a written table; root is the least node of its component."""
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct()
    edges = shared_table(edges, "edges")
    state = None
    for _ in range(MAX_STEPS):
        large = _large_star(edges)
        drop_tables(edges)
        edges = _small_star(large)
        drop_tables(large)
        # Stars only: as many different nodes as edges on one side, and nothing changed.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            found = shared_table(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v"), F.col("v")).distinct()), "components")
            drop_tables(edges)
            return found
        state = now
    raise RuntimeError(f"components did not settle within {MAX_STEPS} steps")
