"""Distribution statistics per group: quantiles, box, ECDF, describe, histogram, cap.

Waits are pre-aggregated to ``(dimension, grp, value, cnt)`` before any
per-group step.  Quantiles, whiskers and ECDFs are looked up in running counts,
which are summed by intervals of values, so neither a dominant group nor
many distinct values ever meet in one task; quantiles of plain rows are bracketed
by a mergeable sketch first, so that few values are shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.timefns import clip_upper, round_exact_array

# The dimensions and groups of the waiting-time comparison.
WAIT_GROUPS = [
    ("time_of_day", "day"), ("time_of_day", "night"),
    ("weekend", "weekday"), ("weekend", "weekend"),
    ("day_type", "holiday"), ("day_type", "weekend"), ("day_type", "weekday"),
]
SUMMARY_PROBS = [0.5, 0.9, 0.95, 0.99]


def group_dim(spark, groups=WAIT_GROUPS) -> DataFrame:
    """The fixed (dimension, group) list as a JVM-side inline table (no Python worker)."""
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(g).alias("grp"), F.lit(i).alias("grp_no"))
            for i, (d, g) in enumerate(groups)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def small_sorted(df: DataFrame, *cols) -> DataFrame:
    """Order a result whose size is bounded by a fixed dimension (7, 24, 50, 168 rows):
    its rows (not the aggregation below) meet in one partition that is sorted there."""
    return df.repartition(1).sortWithinPartitions(*cols)


def wait_groups_long(trans: DataFrame, value_col: str = "waiting_min") -> DataFrame:
    """(dimension, grp, value, cnt): each transition lands in one group of each of the three dimensions.

    Transitions are counted by (time of day, weekend, day type, value) first;
    only that smaller table is expanded to three rows for each of its rows.
    """
    h = F.hour("start_ts")
    tod = F.when((h >= 6) & (h < 18), F.lit("day")).otherwise(F.lit("night"))
    wk = F.when(F.col("is_weekend"), F.lit("weekend")).otherwise(F.lit("weekday"))
    counted = (trans.select(tod.alias("_tod"), wk.alias("_wk"), "day_type", F.col(value_col).cast("double").alias("value"))
               .groupBy("_tod", "_wk", "day_type", "value").agg(F.count(F.lit(1)).alias("cnt")))
    arr = F.array(
        F.struct(F.lit("time_of_day").alias("dimension"), F.col("_tod").alias("grp")),
        F.struct(F.lit("weekend").alias("dimension"), F.col("_wk").alias("grp")),
        F.struct(F.lit("day_type").alias("dimension"), F.col("day_type").alias("grp")),
    )
    return counted.select("value", "cnt", F.explode(arr).alias("g")).select("g.dimension", "g.grp", "value", "cnt")


def value_counts(long: DataFrame, keys=("dimension", "grp"), positive: bool = True,
                 transform=None) -> DataFrame:
    """Pre-aggregate ``(keys..., value) -> cnt``; optional ``value > 0`` filter and value transform."""
    df = long.filter(F.col("value").isNotNull())
    if positive:
        df = df.filter(F.col("value") > 0)
    if transform is not None:
        df = df.withColumn("value", transform(F.col("value")))
    times = F.sum("cnt") if "cnt" in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys, "value").agg(times.alias("cnt"))


# Mergeable sketches: items kept, and the share of ranks taken on either side of a quantile. The error of
# a sketch of this size is a fifth of that share; the exact counts show whether it sufficed.
SKETCH_K = 8192
SKETCH_MARGIN = 0.004
INTERVALS = 256           # of values, in prefix sums


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder (``spark.checkpoint.dir``) and read it back.

    Used on pre-aggregated (group, value, cnt) tables that are read more than
    once (size check, quantiles, whiskers): the upstream plan runs once (an
    RDD checkpoint would run it twice), lineage is cut, and a lost executor
    re-reads files instead of recomputing the upstream.
    """
    import uuid
    from pathweave.session import shared_path
    if getattr(df, "_pw_materialized", False):
        return df
    path = shared_path(df.sparkSession, f"pathweave-{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._pw_materialized = True
    return out


def _sketched(ranks: list[float]) -> Column:
    """The quantiles of a sketch ``_k`` at the given ranks; null for a sketch of no values."""
    return F.when(F.kll_sketch_get_n_double("_k") > 0, F.kll_sketch_get_quantile_double("_k", F.lit([float(r) for r in ranks])))


def _intervals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_pid``, the number of the interval its value lies in; intervals hold about equally many rows.

    The ends of the intervals (at most ``INTERVALS`` numbers) come from one mergeable sketch of all values.
    """
    from pyspark.ml.feature import Bucketizer

    ranks = [i / INTERVALS for i in range(1, INTERVALS)]
    ends = rows.agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("_k")).select(_sketched(ranks)).first()[0] or []
    splits = [-float("inf"), *sorted(set(ends)), float("inf")]
    if len(splits) < 3:
        return rows.withColumn("_pid", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="value", outputCol="_pid").transform(rows)      # a binary search


def cumulative_counts(counts: DataFrame, keys=(), keep=()) -> DataFrame:
    """Add ``n_le`` (values <= value in the group) and ``n`` (group size) to (keys, value, cnt).

    A distributed prefix sum: rows meet by (group, interval of values), where they are sorted and summed, and
    the totals of the group's earlier intervals are added.  All ranks, whiskers and steps of an ECDF are looked
    up in these running counts.  The counts are written once to the shared folder, unless they have an
    interval number ``_pid`` already; running counts are returned as they are.  ``keep`` names columns to carry.
    """
    if "n_le" in counts.columns:
        return counts
    keys = list(keys)
    if "_pid" not in counts.columns:
        counts = _intervals(materialize(counts.withColumn("value", F.col("value").cast("double")), "counts"))
    run = Window.partitionBy(*keys, "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_k_{c}" for c in keys]
    tot = counts.groupBy(*[F.col(c).alias(k) for c, k in zip(keys, names, strict=True)], F.col("_pid").alias("_p")).agg(F.sum("cnt").alias("_pt"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*names, "_p", F.coalesce(F.sum("_pt").over(before), F.lit(0)).alias("_off"),
                     F.sum("_pt").over(Window.partitionBy(*names)).alias("n"))
    on = F.col("_pid") == F.col("_p")
    for c, k in zip(keys, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return (counts.withColumn("_lc", F.sum("cnt").over(run)).join(off, on)
            .select(*keys, "value", "cnt", *keep, (F.col("_lc") + F.col("_off")).alias("n_le"), "n"))


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's interpolation: from the nearer end, so that t = 0 and t = 1 are exact."""
    return F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)


def _ranks(probs) -> list[Column]:
    pos = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    return [edge(x) for x in pos for edge in (F.floor, F.ceil)]


def _holds(rank: Column) -> Column:
    """Whether a row of running counts is the one at this rank."""
    return (F.col("n_le") - F.col("cnt") <= rank) & (rank < F.col("n_le"))


def _quantiles_of(running: DataFrame, keys, probs, *more: Column) -> DataFrame:
    """(keys..., n, _q, more...) from running counts: every rank is looked up in the same rows, in one partial aggregation."""
    at = [F.max(F.when(_holds(r), F.col("value"))) for r in _ranks(probs)]
    found = (running.groupBy(*keys) if keys else running.groupBy()).agg(F.max("n").alias("n"), F.array(*at).alias("_s"), *more)
    pos = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    q = [_lerp(F.col("_s")[2 * i], F.col("_s")[2 * i + 1], x - F.floor(x)) for i, x in enumerate(pos)]
    return found.filter(F.col("n") > 0).withColumn("_q", F.array(*q)).drop("_s")


def _near_ranks(rows: DataFrame, probs, margin: float) -> DataFrame:
    """(_pid, value, cnt, one) of all rows: values near the quantiles are counted each, what lies between them as one row.

    ``one`` says whether a row stands for one value only.  The first pass is a mergeable sketch; the second
    counts values between the sketch's quantiles ``margin`` below and above each probability, so
    that only these values are shuffled.
    """
    lows, highs = ([min(max(p + d, 0.0), 1.0) for p in sorted(probs)] for d in (-margin, margin))
    bounds = rows.agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("_k")).select(_sketched(lows + highs)).first()[0]
    lows, highs = (bounds[:len(lows)], bounds[len(lows):]) if bounds else ([], [])
    gap, near = F.lit(0), F.lit(False)
    for lo, hi in zip(lows, highs, strict=True):
        gap = gap + (F.col("value") > hi).cast("int")                  # brackets that end below the value
        near = near | F.col("value").between(lo, hi)
    placed = rows.select("value", gap.alias("_pid"), F.when(near, F.col("value")).alias("_near"))
    counted = placed.groupBy("_pid", "_near").agg(F.count(F.lit(1)).alias("cnt"), F.min("value").alias("_min"), F.max("value").alias("value"))
    return counted.select("_pid", "value", "cnt", (F.col("_min") == F.col("value")).alias("one"))


def group_quantiles(rows: DataFrame, keys=(), probs=SUMMARY_PROBS, margin: float = SKETCH_MARGIN) -> DataFrame:
    """(keys..., n, _q array) of exact quantiles (numpy's default method).

    ``rows`` are (keys, value, cnt) or running counts of these, or plain (value) rows without keys.  Plain rows
    are read twice: a sketch brackets the ranks, then the values in the brackets are counted.  Should a
    rank fall outside its bracket, which the counts show, all values are counted.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    if "n_le" in rows.columns:
        return _quantiles_of(rows, keys, probs)
    rows = rows.withColumn("value", F.col("value").cast("double")).filter(F.col("value").isNotNull())
    if keys or "cnt" in rows.columns:
        return _quantiles_of(cumulative_counts(_counted(rows, keys), keys), keys, probs)
    near = materialize(_near_ranks(rows.select("value"), probs, margin), "near-ranks")
    missed = F.lit(False)
    for r in _ranks(probs):
        missed = missed | _holds(r)
    found = _quantiles_of(cumulative_counts(near, keep=["one"]), (), probs, F.coalesce(F.bool_or(~F.col("one") & missed), F.lit(False)).alias("_missed"))
    row = found.first()                                                # one row, if any
    if row and row["_missed"]:
        return _quantiles_of(cumulative_counts(_counted(rows, ())), (), probs)
    return rows.sparkSession.range(1 if row else 0).select(
        F.lit(row["n"] if row else 0).cast("bigint").alias("n"), F.lit(row["_q"] if row else [0.0] * len(probs)).alias("_q"))


def _counted(rows: DataFrame, keys) -> DataFrame:
    if "cnt" in rows.columns:
        return rows.select(*keys, "value", "cnt")
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))


def quantile_summary(counts: DataFrame, dim: DataFrame, keys=("dimension", "grp"),
                     probs=SUMMARY_PROBS, names=("median", "p90", "p95", "p99")) -> DataFrame:
    """n and quantiles (rounded like Python's ``round``) per group; empty groups get n = 0 and nulls.

    Exact quantiles use linear interpolation between closest ranks (numpy's
    default) and read the pre-aggregated (or running) counts as frequencies.
    """
    agg = group_quantiles(counts, keys, probs)
    agg = agg.select(*keys, "n", round_exact_array("_q").alias("_q"))
    out = dim.join(agg, list(keys), "left")
    cols = [*keys, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")]
    cols += [F.col("_q")[i].alias(nm) for i, nm in enumerate(names)]
    return small_sorted(out.select(*cols, "grp_no"), "grp_no").drop("grp_no")


def box_stats(counts_log: DataFrame, dim: DataFrame, keys=("dimension", "grp"), whis: float = 1.5) -> DataFrame:
    """Box-plot statistics (quartiles, mean, 1.5 IQR whiskers, outliers) of pre-aggregated (or running) counts.

    Two partial aggregations of the same running counts: quartiles and mean,
    then whiskers and outliers against the fences (one row for each group of ``dim``).
    """
    keys = list(keys)
    if "n_le" in counts_log.columns:
        running = counts_log
    else:
        running = materialize(cumulative_counts(counts_log.join(dim.select(*keys), keys, "left_semi"), keys), "running-counts")
    mean = (F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean")
    q = (_quantiles_of(running, keys, [0.25, 0.5, 0.75], mean).join(dim.select(*keys), keys, "left_semi")
         .select(*keys, "n", "mean", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3")))
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lo_fence", F.col("q1") - F.lit(whis) * F.col("iqr"))
         .withColumn("hi_fence", F.col("q3") + F.lit(whis) * F.col("iqr")))
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    w = (running.join(F.broadcast(q.select(*keys, "lo_fence", "hi_fence")), keys)
         .groupBy(*keys).agg(
             F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
             F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
             F.sum(F.when(~inside, F.col("cnt")).otherwise(F.lit(0))).alias("n_outliers")))
    out = dim.join(q, keys, "left").join(w, keys, "left")
    return (out.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "q1", "median", "q3",
                       "iqr", "whisker_lo", "whisker_hi", F.coalesce("n_outliers", F.lit(0)).cast("long")
                       .alias("n_outliers"), "grp_no")
            .transform(lambda d: small_sorted(d, "grp_no")).drop("grp_no"))


def ecdf(counts: DataFrame, keys=("dimension", "grp")) -> DataFrame:
    """ECDF steps: each distinct value once with the top of its step, y = rank / n (distributed prefix sums)."""
    return (cumulative_counts(counts, keys).withColumn("y", F.col("n_le") / F.col("n"))
            .select(*keys, "value", "cnt", "n_le", "n", "y"))


def describe(values: DataFrame, value_col: str = "value") -> DataFrame:
    """count, mean, sample std, min, quartiles, max (exact quartiles)."""
    v = values.filter(F.col(value_col).isNotNull())
    moments = v.agg(F.count(F.lit(1)).alias("count"), F.avg(value_col).alias("mean"),
                    F.stddev_samp(value_col).alias("std"), F.min(value_col).alias("min"),
                    F.max(value_col).alias("max"))
    qs = group_quantiles(v.select(F.col(value_col).alias("value")), (), [0.25, 0.5, 0.75]).select("_q")
    return (moments.join(qs, F.lit(True), "left")
            .select("count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max"))


def histogram(values: DataFrame, value_col: str = "value", bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed; all ``bins`` rows returned.

    Bin edges follow numpy: edge_i = min + i * (max - min) / bins, and a
    value is moved down/up one bin when it falls outside its computed edges.
    The one-row (min, max) aggregate is cross-joined (broadcast), not collected.
    """
    spark = values.sparkSession
    v = values.select(F.col(value_col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    mm = v.agg(F.min("v").alias("_mn"), F.max("v").alias("_mx"))
    step = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i >= F.lit(bins), F.col("_mx")).otherwise(i * step + F.col("_mn"))

    raw = F.floor((F.col("v") - F.col("_mn")) * (F.lit(float(bins)) / (F.col("_mx") - F.col("_mn"))))
    b0 = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    x = v.crossJoin(F.broadcast(mm)).withColumn("_b", b0)
    x = x.withColumn("_b", F.when((F.col("_mx") != F.col("_mn")) & (F.col("v") < edge(F.col("_b"))),
                                  F.col("_b") - 1).otherwise(F.col("_b")))
    x = x.withColumn("_b", F.when((F.col("_mx") != F.col("_mn")) & (F.col("_b") != bins - 1)
                                  & (F.col("v") >= edge(F.col("_b") + 1)), F.col("_b") + 1).otherwise(F.col("_b")))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    dim = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(mm))
    return (dim.join(counts, dim["bin"] == counts["_b"], "left")
            .select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .transform(lambda d: small_sorted(d, "bin")))


def quantile_cap(values: DataFrame, value_col: str, q: float = 0.99, out: str | None = None) -> DataFrame:
    """Add ``out`` = value clipped above at its q-quantile (one-row aggregate, broadcast-joined)."""
    out = out or f"{value_col}_capped"
    cap = group_quantiles(values.select(F.col(value_col).alias("value")), (), [q]).select(F.col("_q")[0].alias("_cap"))
    return (values.crossJoin(F.broadcast(cap))
            .withColumn(out, clip_upper(F.col(value_col), F.col("_cap"))).drop("_cap"))
