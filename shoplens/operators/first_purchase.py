"""First delivered purchase per customer and what it contained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import share_within
from shoplens.functions.joins import spread_join
from shoplens.operators.category import product_categories
from shoplens.operators.master import PERSON


def first_delivered_order(customers: DataFrame, orders: DataFrame,
                          status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """Per person the earliest delivered order (ties: smaller order id):
    ``customer_unique_id, first_day, order_id``.

    ``min(struct(time, order_id))`` per customer id, then per person: two
    hash aggregates with map-side combine instead of a per-person window.
    With ``facts`` (person_order_facts) it is read from there."""
    if facts is not None:
        return (facts.where(F.col("first_delivered").isNotNull())
                .select(PERSON, F.col("first_delivered.t").alias("first_day"),
                        F.col("first_delivered.oid").alias("order_id")))
    first = F.min(F.struct(F.col("purchase_timestamp").alias("t"), F.col("order_id").alias("oid")))
    per_id = (orders.where(F.col("status") == status)
              .groupBy("customer_id").agg(first.alias("_f")))
    per_person = (per_id.join(customers.select("customer_id", PERSON), "customer_id")
                  .groupBy(PERSON).agg(F.min("_f").alias("_f")))
    return per_person.select(PERSON, F.col("_f.t").alias("first_day"), F.col("_f.oid").alias("order_id"))


def first_order_items(customers: DataFrame, orders: DataFrame, items: DataFrame,
                      products: DataFrame, dictionary: DataFrame,
                      status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """Items of each person's first delivered order with a known category."""
    fo = first_delivered_order(customers, orders, status, facts)
    pc = product_categories(products, dictionary, "drop")
    bought = fo.join(items.select("order_id", "product_id"), "order_id")
    return (spread_join(bought, pc, "product_id", F.col("order_id"))
            .select(PERSON, "first_day", "order_id", "product_id", "product_category",
                    "clean_category", "category_group"))


def single_item_first_mix(first_items: DataFrame, digits: int | None = 4) -> DataFrame:
    """Category shares among persons whose first delivered order has exactly
    one item row with a known category (an unknown second item does not count)."""
    per_person = (first_items.groupBy(PERSON, "first_day")
                  .agg(F.count("product_id").alias("_n"), F.max("category_group").alias("category_group")))
    counts = (per_person.where(F.col("_n") == 1)
              .groupBy("category_group").agg(F.count(F.lit(1)).alias("cnt")))
    return share_within(counts, "cnt", None, "ratio", digits)
