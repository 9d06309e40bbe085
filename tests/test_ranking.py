"""The distributed global-order operator equals Spark's single-task windows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators import ranking as R
from shoplens.operators import selection as S


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of the rows share one value (the hot key of a skewed input)
    return spark.range(0, 2400).select(
        F.col("id").alias("pid"),
        F.when(F.col("id") % 3 == 0, F.lit(50))
        .otherwise(F.col("id") * 7919 % 997).cast("decimal(12,2)").alias("sales"),
        (F.col("id") % 13).alias("cust"),
        (F.col("id") * 31 % 101).alias("t")).cache()


@pytest.mark.parametrize("buckets", [1, 5, 16, 60, 300])
def test_row_number_and_range_sum(skewed, buckets):
    go = R.global_order(skewed, ["sales", "pid"], ["sales"], buckets=buckets)
    got = R.range_running_sum(go, ["sales"], "sales", "cum")
    ref = (skewed.withColumn("rn", F.row_number().over(Window.orderBy("sales", "pid")))
           .withColumn("cum2", F.sum("sales").over(Window.orderBy("sales"))))
    j = got.select("pid", "_rn", "cum").join(ref, "pid")
    assert j.count() == 2400
    assert j.where((F.col("_rn") != F.col("rn")) | (F.col("cum") != F.col("cum2"))).count() == 0
    if buckets > 1:
        sizes = [r["_cnt"] for r in go.stats.collect()]
        assert len(sizes) > 1 and max(sizes) < 2400 * 0.6   # the hot value is split


@pytest.mark.parametrize("buckets", [1, 7, 45, 400])
def test_partitioned_sequence(skewed, buckets):
    go = R.global_order(skewed, ["cust", "t", "pid"], buckets=buckets)
    got = R.partition_lag(R.partition_row_number(go, ["cust"], "n"), go, ["cust"], ["t", "sales"])
    w = Window.partitionBy("cust").orderBy("t", "pid")
    ref = (skewed.withColumn("n2", F.row_number().over(w)).withColumn("pt", F.lag("t").over(w))
           .withColumn("ps", F.lag("sales").over(w)))
    j = got.select("pid", "n", "prev_t", "prev_sales").join(ref, "pid")
    bad = j.where((F.col("n") != F.col("n2")) | ~F.col("prev_t").eqNullSafe(F.col("pt"))
                  | ~F.col("prev_sales").eqNullSafe(F.col("ps")))
    assert bad.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 1002, 2801])
def test_ntile_formula(spark, n):
    df = spark.range(0, n).select(F.col("id").alias("pid"), (F.col("id") % 17).alias("v"))
    got = S.with_ntile(df, "v", "pid", 4, "m", most=7, sample=16)
    ref = df.withColumn("m2", F.ntile(4).over(Window.orderBy("v", "pid")))
    assert got.join(ref, "pid").where(F.col("m") != F.col("m2")).count() == 0


def test_ntile_sizes_differ_by_one(spark):
    df = spark.range(0, 2801).select(F.col("id").alias("pid"), F.col("id").alias("v"))
    sizes = sorted(r["count"] for r in S.with_ntile(df, "v", "pid", 4, "m", most=50, sample=64)
                   .groupBy("m").count().collect())
    assert sizes == [700, 700, 700, 701]


@pytest.mark.parametrize("n,expected", [(4, 2.5), (5, 3.0), (1, 1.0)])
def test_exact_median(spark, n, expected):
    df = spark.range(1, n + 1).select(F.col("id").alias("pid"), F.col("id").cast("decimal(10,2)").alias("v"))
    for most in (1, 100):
        assert S.exact_median(df, "v", "pid", most=most, sample=4).collect()[0][0] == expected


def test_empty_input(spark):
    df = spark.range(0).select(F.col("id").alias("pid"), F.col("id").alias("v"))
    assert S.exact_median(df, "v", "pid").collect()[0][0] is None
    assert S.with_ntile(df, "v", "pid", 4, "m").count() == 0


def test_row_window_is_partitioned_by_bucket(skewed):
    go = R.global_order(skewed, ["sales", "pid"], ["sales"], buckets=6)
    plan = go.df._jdf.queryExecution().executedPlan().toString()
    # rows are windowed per bucket; only the per-bucket stats (<= k rows) see
    # an un-partitioned window
    assert "hashpartitioning(_bkt" in plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_duplicates(spark, seed):
    import random
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0, 1, 1, 1, 2, 3, rnd.randint(0, 40)]), rnd.randint(0, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "pid long, v long, g long")
    k = rnd.choice([3, 11, 30, 280])
    go = R.global_order(df, ["v", "pid"], ["v"], buckets=k)
    got = R.range_running_sum(go, ["v"], "v", "cum")
    ref = (df.withColumn("rn", F.row_number().over(Window.orderBy("v", "pid")))
           .withColumn("cum2", F.sum("v").over(Window.orderBy("v"))))
    assert got.join(ref, "pid").where((F.col("_rn") != F.col("rn")) | (F.col("cum") != F.col("cum2"))).count() == 0
    go2 = R.global_order(df, ["g", "v", "pid"], buckets=k)
    got2 = R.partition_lag(R.partition_row_number(go2, ["g"], "n"), go2, ["g"], ["v"])
    w = Window.partitionBy("g").orderBy("v", "pid")
    ref2 = df.withColumn("n2", F.row_number().over(w)).withColumn("pv", F.lag("v").over(w))
    bad = got2.join(ref2, "pid").where((F.col("n") != F.col("n2")) | ~F.col("prev_v").eqNullSafe(F.col("pv")))
    assert bad.count() == 0


@pytest.mark.parametrize("k", [4, 25])
def test_null_keys(spark, k):
    import random
    rnd = random.Random(k)
    rows = [(i, rnd.choice([None, None, 3, 5, rnd.randint(0, 30)]), rnd.randint(0, 4)) for i in range(800)]
    df = spark.createDataFrame(rows, "pid long, t long, g long")
    go = R.global_order(df, ["g", "t", "pid"], buckets=k)
    got = R.partition_lag(R.partition_row_number(go, ["g"], "n"), go, ["g"], ["t"])
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "pid")
    ref = df.withColumn("n2", F.row_number().over(w)).withColumn("pt", F.lag("t").over(w))
    bad = got.join(ref, "pid").where((F.col("n") != F.col("n2")) | ~F.col("prev_t").eqNullSafe(F.col("pt")))
    assert bad.count() == 0
    go2 = R.global_order(df, ["t", "pid"], ["g"], buckets=k)
    got2 = R.range_running_sum(go2, ["t"], "g", "cum")
    ref2 = df.withColumn("cum2", F.sum("g").over(Window.orderBy(F.col("t").asc_nulls_first())))
    assert got2.join(ref2, "pid").where(~F.col("cum").eqNullSafe(F.col("cum2"))).count() == 0


def test_automatic_bucket_count(spark, skewed):
    assert R.choose_buckets(spark, 0) == 4                 # the session's shuffle partitions
    assert R.choose_buckets(spark, 10**12) == 10**6        # no cap
    go = R.global_order(skewed, ["sales", "pid"], ["sales"], rows_per_bucket=100)
    assert go.stats.count() > 10                           # k = ceil(2400 / 100)
    got = R.range_running_sum(go, ["sales"], "sales", "cum")
    ref = (skewed.withColumn("rn", F.row_number().over(Window.orderBy("sales", "pid")))
           .withColumn("cum2", F.sum("sales").over(Window.orderBy("sales"))))
    j = got.select("pid", "_rn", "cum").join(ref, "pid")
    assert j.where((F.col("_rn") != F.col("rn")) | (F.col("cum") != F.col("cum2"))).count() == 0


def test_small_input_takes_several_buckets(skewed):
    assert R.global_order(skewed, ["sales", "pid"]).stats.count() > 1


def test_user_underscore_columns_survive(spark):
    df = spark.range(0, 50).select(F.col("id").alias("pid"), (F.col("id") % 7).alias("v"),
                                   F.lit("keep").alias("_user_col"))
    out = S.with_ntile(df, "v", "pid", 4, "m")
    assert out.columns == ["pid", "v", "_user_col", "m"]
