"""One product or customer id with a third of all rows is no single task's work."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shoplens.functions.joins import hot_keys, spread_join
from shoplens.operators import category, cohort, master, quality


@pytest.fixture
def no_help(spark):
    """No broadcast and no adaptive splitting: only the operator spreads keys."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold",
                                           "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def shop(spark, n, cold=2_000):
    items = spark.range(n).select(
        F.concat(F.lit("o"), F.col("id")).alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % cold)).alias("product_id"),
        F.lit(1).cast("decimal(10,2)").alias("price"))
    products = spark.range(cold).select(F.concat(F.lit("p"), F.col("id")).alias("product_id"), F.lit("c").alias("product_category")) \
        .unionByName(spark.createDataFrame([("hot", "c")], "product_id string, product_category string"))
    dictionary = spark.createDataFrame([("c", "c", "c", "G")], "product_category string, product_category_eng string, "
                                                               "clean_category string, category_group string")
    return items, products, dictionary


@pytest.mark.parametrize("n", [30_000, 300_000])
def test_hot_product_is_spread(spark, no_help, n):
    """A third of all items on one product: no task holds more than twice the median."""
    out = category.item_categories(*shop(spark, n))
    assert out.count() == n
    tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert len(tasks) == 16 and tasks[-1] <= 2 * tasks[8]
    hot = [r["count"] for r in out.where("product_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(hot) > 8 and sum(hot) == n // 3


def test_hot_customer_is_spread(spark, no_help):
    orders = spark.range(60_000).select(F.col("id").alias("order_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("customer_id"),
                                        F.lit("d").alias("status"), F.timestamp_seconds(F.col("id")).alias("purchase_timestamp"))
    customers = spark.range(5000).select(F.col("id").alias("customer_id"), (F.col("id") % 999).alias("customer_unique_id"))
    assert [k for k, _ in hot_keys(orders, "customer_id")] == [7]
    joined = spread_join(orders, customers, "customer_id", F.col("order_id"))
    tasks = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 2 * tasks[len(tasks) // 2]
    assert cohort.first_order(customers, orders, "d", buckets=4).count() == 60_000


def test_only_hot_keys_are_copied(spark, no_help):
    items, products, _ = shop(spark, 60_000)
    hot = hot_keys(items, "product_id")
    assert [k for k, _ in hot] == ["hot"] and 16 <= hot[0][1] <= 64            # a third of 16 tasks in eighths
    plan = spread_join(items, products, "product_id", F.col("order_id"))
    assert plan.count() == 60_000
    cold = items.where("product_id != 'hot'")
    assert hot_keys(cold, "product_id") == []
    assert "Generate" not in spread_join(cold, products, "product_id", F.col("order_id"))._jdf.queryExecution().executedPlan().toString()


def test_spread_join_equals_join(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, 3)
                                    .otherwise(F.col("id") % 70).cast("long").alias("k"), "id")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    assert hot_keys(left, "k") == [(3, hot_keys(left, "k")[0][1])]
    for how in ("inner", "left"):
        want = left.join(right, "k", how).collect()
        assert sorted(map(str, spread_join(left, right, "k", F.col("id"), how=how).collect())) == sorted(map(str, want))
    empty = left.where("id < 0")
    assert spread_join(empty, right, "k", F.col("id")).count() == 0
    assert spread_join(empty, right, "k", F.col("id"), "left").count() == 0


def test_distinct_counts_copy_no_rows(spark):
    rows = [("a", "X", "x", "S", 1), ("a", "x", "x", "S", 2), ("a", None, None, "T", 3), ("b", "Y", "y", None, 4), ("b", "Y", "y", None, 5),
            (None, "Z", "z", "S", 6), (None, "z", "z", "S", 7)]
    df = spark.createDataFrame(rows, "zip string, city string, clean_city string, state string, id int")
    drift = quality.attribute_drift(df, "zip", ["state", "city"])
    varied = quality.variant_report(df, "zip")
    both = quality.mapping_cardinality(df, ["city", "clean_city"])
    for out in (drift, varied, both):
        assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, drift.collect()), key=str) == [("a", 2, 2), (None, 1, 2)]
    assert list(map(tuple, varied.collect())) == [(None, 2, 1, 1, 2), ("a", 2, 1, 2, 3)]
    assert tuple(both.first()) == (5, 3)


@pytest.mark.parametrize("summed", ["groups", "types"])
def test_sums_per_order_move_rows_once(spark, no_help, summed):
    """Sums bucketed on the order are dealt to the orders once, and no sums over
    almost as many groups as rows are made (and spilled) before that."""
    items, products, dictionary = shop(spark, 3_000)
    if summed == "groups":
        out, other = category.order_group_summary(items, products, dictionary), 2
    else:
        out, other = master.order_type_totals(items.selectExpr("order_id", "product_id AS payment_type", "price AS payment_value")), 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = out.repartition(n, "order_id")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("order_id" in x for x in exchanges) == 1
    above = plan[:plan.index("Exchange hashpartitioning(order_id")]
    assert above.count("HashAggregate(") == plan.count("HashAggregate(") == 2


def test_order_with_most_items_is_summed_first(spark, no_help):
    """An order with a third of all items, and items without an order: the sums are those of a plain aggregation."""
    items, products, dictionary = shop(spark, 60_000, 50)
    order = F.when(F.col("price") > 0, F.when(F.col("product_id") == "hot", "o1").when(F.col("product_id") != "p1", F.col("order_id")))
    items = items.withColumn("order_id", order)
    assert [k for k, _ in hot_keys(items, "order_id")] == ["o1"]
    got = category.order_group_summary(items, products, dictionary)
    want = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"))
    assert got.schema["_sales"].dataType == want.schema["s"].dataType
    assert sorted(map(tuple, got.select("order_id", "_items", "_sales").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    paid = items.selectExpr("order_id", "product_id AS payment_type", "price AS payment_value")
    got = master.order_type_totals(paid)
    want = paid.groupBy("order_id", "payment_type").agg(F.sum("payment_value").alias("payment_value"))
    assert got.schema["payment_value"].dataType == want.schema["payment_value"].dataType
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
