"""Views that outlive a session, their retention, and their layout by order id."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shoplens.plans import cache, catalog
from shoplens.plans.cache import Views

SF = "/root/testdata/sf0.001"


def never():
    raise AssertionError("the view is there already")


def frame(spark, n=50):
    return spark.range(n).select((F.col("id") % 7).alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"),
                                 F.col("id").cast("decimal(12,2)").alias("m"))


@pytest.mark.parametrize("bucket", [None, "k"])
def test_second_store_builds_nothing(spark, bucket):
    folder = f"/data/second-{bucket}"
    df = frame(spark)
    one = Views(spark, folder, ("state", 1)).get("v", lambda: df, bucket)
    two = Views(spark, folder, ("state", 1)).get("v", never, bucket)
    assert two.dtypes == df.dtypes and sorted(two.collect()) == sorted(df.collect())
    assert sorted(one.inputFiles()) == sorted(two.inputFiles())


def test_bucketed_view_of_another_session(spark):
    store = Views(spark, "/data/other-session", 1)
    store.get("v", lambda: frame(spark), "k")
    other = spark.newSession()
    import json
    m = json.loads(store.files.read(store.place("v.json")))
    spark.sql(f"DROP TABLE {cache._table_name(m['path'])}")       # an external table: its files stay
    back = Views(other, "/data/other-session", 1).get("v", never, "k")
    assert back.count() == 50 and m["rows"] == 50
    other.conf.set("spark.sql.adaptive.enabled", "false")
    plan = back.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_changed_files_and_retention(spark):
    folder = "/data/changes"
    for state in range(5):
        store = Views(spark, folder, state)
        assert store.get("v", lambda: frame(spark, state + 1)).count() == state + 1
    left = [s for _, s in store.files.folders(store.home)]
    assert len(left) == cache.KEEP_STATES and store.state in left
    assert store.prune(1) == [s for s in left if s != store.state]
    assert store.get("v", never).count() == 5


def test_unfinished_view_is_built_again(spark):
    store = Views(spark, "/data/unfinished", 0)
    frame(spark, 3).write.parquet(store.place("v-dead"))          # rows without a manifest
    assert store.get("v", lambda: frame(spark, 9)).count() == 9


def test_empty_view(spark):
    store = Views(spark, "/data/empty", 0)
    assert store.get("v", lambda: frame(spark, 0), "k").count() == 0
    assert Views(spark, "/data/empty", 0).get("v", never, "k").count() == 0


def test_run_folder_is_removed(spark):
    df = cache.materialize(frame(spark), "gone")
    folder = os.path.dirname(os.path.dirname(df.inputFiles()[0].replace("file://", "")))
    assert os.path.isdir(folder)
    cache.remove_run(spark)
    assert not os.path.exists(folder)
    assert cache.materialize(frame(spark), "again").count() == 50


def test_orders_and_payments_join_where_they_lie(spark):
    """No exchange on the order id in the reports' plans, nor in those that build their views."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    c = catalog.context(spark, SF)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        from shoplens.operators import master, sequence, trend
        t = c.t
        plans = {"monthly_sales": trend.monthly_sales(c.orders, c.paid, t.delivered),
                 "monthly_sales_by_type": trend.monthly_sales_by_type(c.orders, c.paid_types, t.delivered),
                 "total_sales": trend.total_sales(c.orders, c.paid, t.delivered),
                 "person facts": master.person_order_facts(t.customers, c.orders, c.paid, t.delivered),
                 "one_customer": master.one_customer(t.customers, c.orders, c.facts),
                 "orders of repeat customers": sequence.repeat_customer_orders(
                     c.master, t.customers, c.orders.join(c.paid, "order_id", "left"), None, ("order_payment_total",))}
        for name, df in plans.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(order_id" not in plan, name
        assert "SortMergeJoin [order_id" in plans["monthly_sales"]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
