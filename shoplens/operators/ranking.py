"""Distributed global ordering: row numbers and running sums without a window
that has no PARTITION BY. Single ranks (medians, the cuts of NTILE) need no
order of all rows: see :mod:`shoplens.operators.selection`.

A window such as ``ROW_NUMBER() OVER (ORDER BY sales)`` puts every row into a
single task (Spark plans ``SinglePartition``). ``global_order`` computes the
same numbers in parallel, with one plan at every size:

1. ``repartitionByRange`` on the full ordering key deals the rows to buckets.
   The key ends in a unique tie-breaker, so one very frequent value is spread
   over several buckets;
2. the rows are written once, with their bucket number, to shared storage:
   from there on the bucket of a row is data and cannot change when a task is
   run again;
3. per-bucket counts, sums and end keys (one row a bucket) give prefix offsets;
4. inside each bucket an ordinary window ``PARTITION BY _bkt ORDER BY key``
   gives local row numbers / running sums; adding the offset makes them global.

Groups of equal values that straddle buckets (RANGE peers, partition groups
for per-customer sequences) are those whose key prefix is the last of one
bucket and the first of a later one; they are corrected from per-bucket
aggregates (see below).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.joins import hot_keys
from shoplens.plans.cache import keep, materialize

ROWS_PER_BUCKET = 1_000_000


@dataclass
class GlobalOrder:
    """Result of :func:`global_order`.

    ``df``: input columns + ``_bkt``, ``_lrn`` (row number inside the bucket),
    ``_rn`` (global 1-based row number), ``_run_<c>`` (global ROWS running sum
    of each requested column, up to and including the row), and the bucket
    offsets ``_off_cnt``, ``_off_<c>``. Drop them with :func:`drop_internal`.
    ``stats``: one row per non-empty bucket (``_bkt, _cnt, _off_cnt, _sum_<c>,
    _off_<c>``, first and last key ``_lo`` and ``_hi``).
    ``totals``: one row (``_n, _total_<c>``).
    """

    df: DataFrame
    pre: DataFrame          # input + _bkt, before any window (for per-bucket aggregates)
    stats: DataFrame
    totals: DataFrame
    order_cols: list[str]
    sum_cols: list[str]


def _key(cols: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in cols])


def choose_buckets(spark, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """One bucket per ``rows_per_bucket`` rows, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_bucket))


def global_order(df: DataFrame, order_cols: list[str], sum_cols: list[str] = (),
                 buckets: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> GlobalOrder:
    """Global ascending order over ``order_cols`` (NULLs first), computed in buckets.

    ``order_cols`` must be a unique key of ``df`` (add an id as the last
    column): rows with the same full key are indistinguishable, so no range
    could split a group of such copies. Callers here order by aggregated
    persons or by the declared order key, and
    :func:`shoplens.operators.quality.integrity_report` reports key
    violations. ``df`` is read for its count (unless ``buckets`` is given), for
    the range sample and for the write.
    """
    order_cols, sum_cols = list(order_cols), list(sum_cols)
    k = buckets or choose_buckets(df.sparkSession, df.count(), rows_per_bucket)
    ranged = df.repartitionByRange(k, *[F.col(c).asc_nulls_first() for c in order_cols])
    b = materialize(ranged.withColumn("_bkt", F.spark_partition_id()), f"order_{uuid.uuid4().hex[:12]}")
    key = _key(order_cols)
    stats = b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_cnt"), F.min(key).alias("_lo"), F.max(key).alias("_hi"),
                                  *[F.sum(c).alias(f"_sum_{c}") for c in sum_cols])
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # <= k rows
    stats = stats.withColumn("_off_cnt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    for c in sum_cols:
        stats = stats.withColumn(f"_off_{c}", F.coalesce(F.sum(f"_sum_{c}").over(before),
                                                         F.lit(0).cast(stats.schema[f"_sum_{c}"].dataType)))
    # k rows, read by the offsets, the totals and the corrections: computed once.
    stats = keep(stats)
    totals = stats.agg(F.sum("_cnt").alias("_n"),
                       *[F.sum(f"_sum_{c}").alias(f"_total_{c}") for c in sum_cols])

    w = Window.partitionBy("_bkt").orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    rows_w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = b.withColumn("_lrn", F.row_number().over(w))
    for c in sum_cols:
        ranked = ranked.withColumn(f"_lrun_{c}", F.sum(c).over(rows_w))
    ranked = _with_bucket(ranked, stats.select("_bkt", "_off_cnt", *[f"_off_{c}" for c in sum_cols])) \
        .withColumn("_rn", F.col("_off_cnt") + F.col("_lrn"))
    for c in sum_cols:
        ranked = ranked.withColumn(f"_run_{c}", F.col(f"_off_{c}") + F.col(f"_lrun_{c}"))
    ranked = ranked.drop(*[f"_lrun_{c}" for c in sum_cols])
    return GlobalOrder(ranked, b, stats, totals, order_cols, sum_cols)


def _with_bucket(df: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """Rows with columns of their bucket (one row per bucket: rows / ROWS_PER_BUCKET
    of them). The rows are already together by ``_bkt`` for their window, so
    this needs no further shuffle of them, whichever join is picked."""
    return df.join(per_bucket, "_bkt", "left")


# ---------------------------------------------------------------------------
# groups that straddle buckets
#
# For a key prefix of length p let lo(b) and hi(b) be the prefixes of the first
# and last key of bucket b. Buckets are ordered, so a group g that leaves
# bucket b has hi(b) = g = lo(c) for a later bucket c, and every bucket between
# holds g alone. The corrections below are functions of the bucket, taken from
# per-bucket aggregates (map-side partial aggregation, one row a bucket).
# ---------------------------------------------------------------------------

def _edges(go: GlobalOrder, p: int) -> DataFrame:
    """Per bucket: the prefixes ``_low`` and ``_high`` of its end keys."""
    def prefix(name: str) -> Column:
        return F.struct(*[F.col(f"{name}.{c}").alias(c) for c in go.order_cols[:p]])
    return go.stats.select("_bkt", "_cnt", "_off_cnt", *[f"_off_{c}" for c in go.sum_cols],
                           prefix("_lo").alias("_low"), prefix("_hi").alias("_high"))


def range_running_sum(go: GlobalOrder, peer_cols: list[str], c: str, out: str) -> DataFrame:
    """Running sum of ``c`` with the SQL default frame (RANGE ... CURRENT ROW):
    rows with equal ``peer_cols`` share the value that includes all of them.
    ``peer_cols`` must be a prefix of the order key.
    """
    p = len(peer_cols)
    assert go.order_cols[:p] == list(peer_cols)
    w = Window.partitionBy("_bkt").orderBy(*[F.col(x).asc_nulls_first() for x in peer_cols])
    df = go.df.withColumn("_range_local", F.col(f"_off_{c}") + F.sum(c).over(w))   # RANGE frame
    edges, key = _edges(go, p), _key(list(peer_cols))
    # sum of c over the rows of a bucket whose prefix is its first
    low = _with_bucket(go.pre, edges.select("_bkt", "_low")).groupBy("_bkt").agg(
        F.sum(F.when(key.eqNullSafe(F.col("_low")), F.col(c))).alias("_lowsum"))
    # the last bucket that starts with g holds the end of g
    last = edges.join(low, "_bkt").groupBy("_low").agg(F.max(F.struct(
        "_bkt", (F.col(f"_off_{c}") + F.coalesce("_lowsum", F.lit(0))).alias("_end"))).alias("_last"))
    fix = edges.select("_bkt", "_high").join(last, F.col("_high").eqNullSafe(F.col("_low"))) \
        .where("_last._bkt > _bkt").select("_bkt", "_high", F.col("_last._end").alias("_range_fix"))
    return (_with_bucket(df, fix)
            .withColumn(out, F.when(key.eqNullSafe(F.col("_high")) & F.col("_range_fix").isNotNull(),
                                    F.col("_range_fix"))
                        .otherwise(F.col("_range_local")).cast(df.schema["_range_local"].dataType))
            .drop("_range_fix", "_range_local", "_high"))


def partition_row_number(go: GlobalOrder, part_cols: list[str], out: str) -> DataFrame:
    """Row number inside groups of ``part_cols`` (a prefix of the order key)."""
    p = len(part_cols)
    assert go.order_cols[:p] == list(part_cols)
    rest = go.order_cols[p:]
    w = Window.partitionBy("_bkt", *part_cols).orderBy(*[F.col(x).asc_nulls_first() for x in rest])
    df = go.df.withColumn("_prn_local", F.row_number().over(w))
    edges, key = _edges(go, p), _key(list(part_cols))
    # rows before the group that a bucket ends with: where that group starts
    high = _with_bucket(go.pre, edges.select("_bkt", "_high")).groupBy("_bkt").agg(
        F.count(F.when(key.eqNullSafe(F.col("_high")), F.lit(1))).alias("_cnt_high"))
    first = edges.join(high, "_bkt").groupBy("_high").agg(F.min(F.struct(
        "_bkt", (F.col("_off_cnt") + F.col("_cnt") - F.col("_cnt_high")).alias("_start"))).alias("_first"))
    cont = edges.select("_bkt", "_low", "_off_cnt").join(first, F.col("_low").eqNullSafe(F.col("_high"))) \
        .where("_first._bkt < _bkt").select("_bkt", "_low", (F.col("_off_cnt") - F.col("_first._start")).alias("_cont"))
    return (_with_bucket(df, cont)
            .withColumn(out, F.when(key.eqNullSafe(F.col("_low")) & F.col("_cont").isNotNull(),
                                    F.col("_prn_local") + F.col("_cont"))
                        .otherwise(F.col("_prn_local")))
            .drop("_cont", "_prn_local", "_low"))


def partition_lag(df: DataFrame, go: GlobalOrder, part_cols: list[str], value_cols: list[str],
                  prefix: str = "prev_") -> DataFrame:
    """Value of the previous row (global order) inside the same ``part_cols`` group.

    ``df`` is ``go.df`` or a frame derived from it row by row (same ``_bkt``,
    ``_lrn``). The first row of a bucket takes its predecessor from the last
    row of the previous non-empty bucket (per-bucket maximum of the key, at
    most k rows).
    """
    fields = part_cols + value_cols
    w = Window.partitionBy("_bkt").orderBy(*[F.col(x).asc_nulls_first() for x in go.order_cols])
    row = F.struct(*[F.col(x).alias(x) for x in fields])
    df = df.withColumn("_prev", F.lag(row).over(w))
    keyed = F.struct(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(go.order_cols)], row.alias("_row"))
    last = go.pre.groupBy("_bkt").agg(F.max(keyed)["_row"].alias("_last"))
    prev_last = last.select(
        F.lead("_bkt").over(Window.orderBy("_bkt")).alias("_bkt"),      # <= k rows
        F.col("_last").alias("_prev_bkt_last")).where(F.col("_bkt").isNotNull())
    df = (_with_bucket(df, prev_last)
          .withColumn("_prev", F.when(F.col("_lrn") == 1, F.col("_prev_bkt_last")).otherwise(F.col("_prev")))
          .drop("_prev_bkt_last"))
    same = F.lit(True)
    for p in part_cols:
        same = same & F.col("_prev")[p].eqNullSafe(F.col(p))
    for v in value_cols:
        df = df.withColumn(prefix + v, F.when(same, F.col("_prev")[v]))
    return df.drop("_prev")


def numbered(df: DataFrame, part: str, order_cols: list[str], number: str, lags: list[str] = (),
             buckets: int | None = None, heavy: list | None = None) -> DataFrame:
    """Rows of each ``part`` group numbered by ``order_cols``, with the values
    of ``lags`` in the group's previous row (``prev_<c>``).

    Groups that fit a task are numbered by a plain window, one shuffle. Groups
    that outweigh one (``heavy``; measured by :func:`shoplens.functions.joins.hot_keys`
    unless given) are ordered in buckets. ``buckets``: all groups are, in so
    many. ``part`` and ``order_cols`` together must be a unique key."""
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    if buckets is None and heavy is None:
        heavy = [k for k, _ in hot_keys(df, part)]
    parts = []
    if buckets is None:
        light = df
        if heavy:
            # At most hot_keys' LISTED keys, so broadcasting them is safe at every size.
            keys = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in heavy], df.select(part).schema))
            light, df = df.join(keys, part, "left_anti"), df.join(keys, part, "left_semi")
        w = Window.partitionBy(part).orderBy(*order)
        out = light.withColumn(number, F.row_number().over(w))
        for c in lags:
            out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
        parts.append(out)
    if buckets is not None or heavy:
        go = global_order(df, [part, *order_cols], buckets=buckets)
        out = partition_row_number(go, [part], number)
        parts.append(drop_internal(partition_lag(out, go, [part], list(lags)) if lags else out).select(
            *df.columns, F.col(number).cast("int").alias(number), *[f"prev_{c}" for c in lags]))
    return reduce(DataFrame.unionByName, parts)


_INTERNAL = re.compile(r"^_(bkt|lrn|rn|off_\w+|run_\w+|lrun_\w+|range_\w+|prn_\w+|cont|low|high|prev\w*)$")


def drop_internal(df: DataFrame) -> DataFrame:
    """Drop the helper columns this module adds (``_bkt``, ``_rn``, offsets,
    running sums, ...); other columns, even with a leading underscore, stay."""
    return df.drop(*[c for c in df.columns if _INTERNAL.match(c)])
