"""Joins whose left keys may be hot.

How hot a key is gets measured, by a frequent-items summary of the left keys
(one pass over one column, partial summaries merged; it holds ``TRACKED`` items
whatever the number of keys). Only keys that would outweigh a task are split,
each into as many sub-keys as its share of the rows asks for; rows of all other
keys, and the right side of all other keys, are joined plainly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED = 100_000    # items of the summary: counts are off by at most 4 rows in so many
LISTED = 10_000      # keys that are looked at; any other key has less than a ten-thousandth of the rows
FINENESS = 8         # sub-keys of a hot key per task's fair share of rows
WORTH = 1_000        # rows below which a key is not worth splitting


def hot_keys(rows: DataFrame, key: str, tasks: int | None = None) -> list[tuple[object, int]]:
    """(key, sub-keys) of the keys that hold more than half of a task's fair
    share of ``rows``, were they dealt to ``tasks`` tasks (the session's shuffle
    partitions). At most ``LISTED`` entries; counts are those of the summary."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = "`" + key.replace("`", "``") + "`"
    seen = rows.where(F.col(name).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({name}, {LISTED}, {TRACKED})").alias("top")).first()
    fair = max(1.0, seen.n / tasks)
    return [(x["item"], math.ceil(FINENESS * min(x["count"], seen.n) / fair)) for x in seen.top or []
            if x["count"] > fair / 2 and x["count"] >= WORTH]


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner",
                tasks: int | None = None) -> DataFrame:
    """Join on ``key``, unique in ``right``, in which a hot left key is dealt to
    sub-keys by a hash of ``spread`` and the right row of that key, and of no
    other, is given to all of them. Left rows without a key, which match
    nothing, are dealt out as well. Where ``right`` is small Spark still
    broadcasts it by its size."""
    hot = hot_keys(left, key, tasks)
    missing = F.col(key).isNull()
    if not hot and how == "inner":
        return left.join(right, key, how)
    # At most LISTED rows, so broadcasting them is safe at every size.
    kind = T.StructType([T.StructField(key, left.schema[key].dataType), T.StructField("_parts", T.IntegerType())])
    parts = F.broadcast(left.sparkSession.createDataFrame(hot, kind))
    own = F.coalesce(F.col("_parts"), F.lit(1))
    lonely = F.when(missing, F.pmod(F.xxhash64(spread), F.lit(1 << 20)))
    a = left.join(parts, key, "left").withColumn("_part", F.coalesce(lonely, F.pmod(F.xxhash64(spread), own)).cast("int")).drop("_parts")
    b = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), own - 1))).drop("_parts")
    return a.join(b, [key, "_part"], how).drop("_part")


def gathered(rows: DataFrame, key: str, reduce: Callable[[DataFrame], DataFrame], counted: DataFrame | None = None
             ) -> DataFrame:
    """Rows dealt by ``key`` to the session's shuffle partitions, ahead of an
    aggregation by ``key`` and more columns: its groups are whole there, and a
    view bucketed on ``key`` is written as they lie, so the rows move once.

    Sums made before the rows move would hold nearly as many groups as a task
    has rows and spill once they outgrow its memory. Only the rows of hot keys
    are reduced first, by ``reduce`` (to columns of the same names, which the
    aggregation can sum again). ``counted``: a plainer frame with the same keys,
    in which hot ones are looked for where ``rows`` are the result of a join."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(rows if counted is None else counted, key)
    if hot:
        # At most LISTED keys, so broadcasting them is safe at every size.
        kind = T.StructType([T.StructField(key, rows.schema[key].dataType)])
        keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k, _ in hot], kind))
        rows = rows.join(keys, key, "left_anti").unionByName(reduce(rows.join(keys, key, "left_semi")))
    return rows.repartition(n, key)
