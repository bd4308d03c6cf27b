"""Scaling / skew check on data derived from the given tables.

The sf0.1 ``events`` log is replicated ``REPS`` times with the case id offset
per copy (so it keeps its shape), and a skewed variant folds a third of all
rows into one case.  Reports time of the transition table with the plain
per-case window and with hot-case splitting, and checks both give the same rows.

usage: python tools/skew_check.py [sf_dir] [reps]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pathweave.operators.trace import SkewPolicy, with_successor  # noqa: E402
from pathweave.session import cleanup_shared, get_spark, shared_path  # noqa: E402
from pathweave.sources.eventlog import events_as_log  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    reps = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    base = events_as_log(spark, sf)
    big = (base.crossJoin(spark.range(reps).withColumnRenamed("id", "_r"))
           .withColumn("case_id", F.col("case_id") + F.col("_r") * 1_000_000_000)
           .withColumn("event_id", F.col("event_id") + F.col("_r") * 1_000_000_000).drop("_r"))
    path = shared_path(spark, "skew-check-log")
    big.write.mode("overwrite").parquet(path)
    log = spark.read.parquet(path)
    skewed = log.withColumn("case_id", F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.lit(-1))
                            .otherwise(F.col("case_id")))
    n = log.count()
    policy = SkewPolicy(hot_case_rows=max(1000, n // 50), segment_rows=max(500, n // 200))
    out = {"rows": n, "policy": policy.__dict__}
    cols = ["case_id", "event_id", "next_start", "next_activity"]

    def run(df, pol):
        t0 = time.perf_counter()
        r = with_successor(df, policy=pol).select(*cols)
        agg = r.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64(*cols), F.lit(1_000_000_007)))).first()
        return time.perf_counter() - t0, tuple(agg)

    for name, df in (("uniform", log), ("one_case_third", skewed)):
        run(df, None)  # warm
        tp, hp = run(df, None)
        ts, hs = run(df, policy)
        out[name] = {"plain_sec": round(tp, 3), "split_sec": round(ts, 3), "same_rows": hp == hs}
    print(json.dumps(out))
    cleanup_shared(spark)


if __name__ == "__main__":
    main()
