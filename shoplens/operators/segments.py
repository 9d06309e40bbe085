"""Behaviour of value segments: category mix, order-count distributions,
regional share of core customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import money, rounded_ratio, share_within
from shoplens.operators.category import order_category_counts
from shoplens.operators.master import PERSON


def orders_per_person(customers: DataFrame, orders: DataFrame, status: str | None = None,
                      facts: DataFrame | None = None) -> DataFrame:
    """Order count per person (any status unless given); counts are reduced
    per customer id before the join to customers. With ``facts`` (from
    :func:`shoplens.operators.master.person_order_facts`, built for the same
    status) the counts are read from there."""
    if facts is not None:
        if status is None:
            return facts.select(PERSON, F.col("order_cnt").alias("order_count"))
        return facts.where(F.col("n_delivered") >= 1).select(PERSON, F.col("n_delivered").alias("order_count"))
    o = orders if status is None else orders.where(F.col("status") == status)
    per_id = o.groupBy("customer_id").agg(F.count("order_id").alias("_n"))
    return (per_id.join(customers.select("customer_id", PERSON), "customer_id")
            .groupBy(PERSON).agg(F.sum("_n").cast("bigint").alias("order_count")))


def segment_category_mix(segments: DataFrame, customers: DataFrame, orders: DataFrame,
                         items: DataFrame, products: DataFrame, dictionary: DataFrame,
                         by: str = "pareto_segment", digits: int | None = 4,
                         summary: DataFrame | None = None) -> DataFrame:
    """Item rows per (segment, category group) over all orders of the
    segment's customers (known categories only), and the share within the segment.

    Item rows are reduced to (order, group) counts, then to (customer id,
    group), then joined to persons and segments: no join sees a hot key."""
    per_order = order_category_counts(items, products, dictionary, "drop", summary)
    per_id = (per_order.join(orders.select("order_id", "customer_id"), "order_id")
              .groupBy("customer_id", "category_group").agg(F.sum("_items").alias("_items")))
    per_person = per_id.join(customers.select("customer_id", PERSON), "customer_id")
    counts = (per_person.join(segments.select(PERSON, by), PERSON)
              .groupBy(by, "category_group").agg(F.sum("_items").cast("bigint").alias("cnt")))
    return share_within(counts, "cnt", [by], "ratio", digits)


def segment_order_counts(segments: DataFrame, customers: DataFrame, orders: DataFrame,
                         by: str = "pareto_segment", digits: int | None = 4,
                         facts: DataFrame | None = None) -> DataFrame:
    """Distribution of the number of orders (any status) per segment."""
    per_person = orders_per_person(customers, orders, None, facts)
    counts = (segments.select(PERSON, by).join(per_person, PERSON)
              .groupBy(by, "order_count").agg(F.count(F.lit(1)).alias("customer_cnt")))
    return share_within(counts, "customer_cnt", [by], "ratio", digits)


def order_count_distribution(master: DataFrame, customers: DataFrame, orders: DataFrame,
                             status: str = "delivered", digits: int | None = 4,
                             facts: DataFrame | None = None) -> DataFrame:
    """Distribution of the number of delivered orders (paid or not) over the
    master's persons that have at least one."""
    per_person = orders_per_person(customers, orders, status, facts)
    counts = (per_person.join(master.select(PERSON), PERSON)
              .groupBy("order_count").agg(F.count(F.lit(1)).alias("customer_cnt")))
    return share_within(counts, "customer_cnt", None, "ratio", digits)


def region_core_share(segments: DataFrame, master: DataFrame, digits: int = 4) -> DataFrame:
    """Per (state, city): customers above the structure cut and above average
    sales, their shares, and the area's sales."""
    m = master.where(F.col("delivered_order_cnt") >= 1).select(PERSON, "state", "clean_city", "sales")
    j = segments.select(PERSON, "structure_segment", "avg_segment").join(m, PERSON)
    g = j.groupBy("state", "clean_city").agg(
        F.sum("structure_segment").cast("bigint").alias("core_cnt"),
        F.sum("avg_segment").cast("bigint").alias("above_avg_cnt"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("sales").alias("_sales"))
    return g.select(
        "state", "clean_city", "core_cnt",
        rounded_ratio("core_cnt", "_n", digits).alias("core_ratio"),
        "above_avg_cnt",
        rounded_ratio("above_avg_cnt", "_n", digits).alias("above_avg_ratio"),
        money("_sales").alias("sales"))
