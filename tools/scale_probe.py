"""Time the distributed global ordering on the largest given table.

Orders all line items of a scale factor by (price, order, line) with 1
bucket (the single-task case) and with more buckets, checks that row numbers
and RANGE running sums agree, and prints the seconds of each run.

Usage: python tools/scale_probe.py [sf_dir] [buckets ...]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from shoplens.operators import ranking as R  # noqa: E402
from shoplens.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    bucket_counts = [int(x) for x in sys.argv[2:]] or [1, 8, 64]
    spark = get_spark()
    items = (spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
             .select(F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
                     "l_orderkey", "l_linenumber")
             .persist())
    n = items.count()
    results = {}
    for k in bucket_counts:
        t0 = time.time()
        go = R.global_order(items, ["price", "l_orderkey", "l_linenumber"], ["price"], buckets=k)
        out = R.range_running_sum(go, ["price"], "price", "cum")
        digest = out.agg(F.sum(F.col("_rn") * F.col("l_linenumber")).alias("a"),
                         F.sum(F.col("cum") % 1000003).alias("b"), F.max("_bkt").alias("m")).collect()[0]
        results[k] = (round(time.time() - t0, 2), digest["a"], digest["b"], digest["m"] + 1)
        print(f"rows={n} buckets={k} used={results[k][3]} seconds={results[k][0]}")
    first = next(iter(results.values()))
    assert all(r[1:3] == first[1:3] for r in results.values()), "results differ"
    print("identical row numbers and running sums across bucket counts")


if __name__ == "__main__":
    main()
