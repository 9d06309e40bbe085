"""STAR cohort versus one-time customers: first-purchase category lift and
the repeat-rate baseline for an A/B design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import count_if, rounded_ratio, safe_ratio
from shoplens.functions.joins import spread_join
from shoplens.operators.category import order_group_summary
from shoplens.operators.first_purchase import first_delivered_order
from shoplens.operators.master import PERSON
from shoplens.operators.ranking import numbered
from shoplens.operators.rfm import HIGH_VALUE, RECENT
from shoplens.plans.cache import keep


def first_order(customers: DataFrame, orders: DataFrame, status: str = "delivered",
                buckets: int | None = None) -> DataFrame:
    """Every delivered order numbered per person by (purchase time, order id)
    as ``fo_num`` (the order id breaks ties the reference leaves open).

    One person with a huge share of the orders is not numbered inside a
    single task (:func:`numbered`). Consumers that only need
    ``fo_num = 1`` use :func:`first_delivered_order` (an aggregate)."""
    o = spread_join(orders.where(F.col("status") == status).select("order_id", "customer_id", "purchase_timestamp"),
                    customers.select("customer_id", PERSON), "customer_id", F.col("order_id")) \
        .select(PERSON, "order_id", "purchase_timestamp")
    out = numbered(keep(o), PERSON, ["purchase_timestamp", "order_id"], "fo_num", buckets=buckets)
    return out.withColumn("fo_num", F.col("fo_num").cast("int"))


def star_customers(scored: DataFrame) -> DataFrame:
    """Recent (ACTIVE, WARM) and high value (M bucket 3, 4)."""
    return scored.where(F.col("r_segment").isin(*RECENT) & F.col("m_bucket").isin(*HIGH_VALUE))


def first_categories(customers: DataFrame, orders: DataFrame, items: DataFrame,
                     products: DataFrame, dictionary: DataFrame,
                     status: str = "delivered", summary: DataFrame | None = None,
                     facts: DataFrame | None = None) -> DataFrame:
    """Distinct (person, category group) of the first delivered order's items
    with a known category. A person has one first order, and the (order,
    group) pairs are distinct already, so no further DISTINCT is needed."""
    fo = first_delivered_order(customers, orders, status, facts).select(PERSON, "order_id")
    if summary is None:
        summary = order_group_summary(items, products, dictionary)
    cats = summary.where(F.col("_known")).select("order_id", "category_group")
    return fo.join(cats, "order_id").select(PERSON, "category_group")


def cohort_match_report(first_cats: DataFrame, cohort: DataFrame) -> DataFrame:
    """How the cohort maps onto first-purchase categories: cohort size,
    customers with >= 1 known category (matched), without (lost), with
    several, total memberships and the excess over one per customer.
    Identity: total_category_memberships = matched_customers + excess_from_multi."""
    c = cohort.select(PERSON)
    per = (first_cats.join(c, PERSON, "left_semi").groupBy(PERSON)
           .agg(F.count_distinct("category_group").alias("_k")))
    m = per.agg(F.count(F.lit(1)).alias("matched_customers"),
                count_if(F.col("_k") > 1).alias("multi_category_customers"),
                F.coalesce(F.sum("_k"), F.lit(0)).cast("bigint").alias("total_category_memberships"))
    total = c.agg(F.count(F.lit(1))).scalar()                   # scalar subquery
    return m.select(
        total.alias("star_total"), "matched_customers",
        (total - F.col("matched_customers")).alias("lost_customers"),
        "multi_category_customers", "total_category_memberships",
        (F.col("total_category_memberships") - F.col("matched_customers")).alias("excess_from_multi"))


def cohort_lift(first_cats: DataFrame, cohort: DataFrame, delivered: DataFrame,
                digits_pct: int = 1, digits_lift: int = 2) -> DataFrame:
    """Per category group: cohort members and one-time customers whose first
    purchase touched it, each as a percentage of its whole group (members
    without a known category included), and lift = cohort % / one-time %.

    A person counts once per category group; repeat customers outside the
    cohort are left out. ``delivered`` is ``customer_delivered_orders``."""
    cohort_ids = cohort.select(PERSON).withColumn("_star", F.lit(True))
    tagged = (first_cats.join(delivered.select(PERSON, "order_freq"), PERSON)
              .join(cohort_ids, PERSON, "left")
              .select("category_group",
                      F.when(F.col("_star"), F.lit("STAR"))
                      .when(F.col("order_freq") == 1, F.lit("ONE_TIME")).alias("group_type"))
              .where(F.col("group_type").isNotNull()))
    counts = tagged.groupBy("category_group").agg(
        count_if(F.col("group_type") == "STAR").alias("star_cnt"),
        count_if(F.col("group_type") == "ONE_TIME").alias("one_time_cnt"))
    star_n = cohort.select(PERSON).agg(F.count(F.lit(1))).scalar()             # scalar subqueries
    one_n = delivered.agg(F.count_if(F.col("order_freq") == 1)).scalar()
    return counts.select(
        "category_group", "star_cnt",
        rounded_ratio("star_cnt", star_n, digits_pct, 100).alias("star_pct"),
        "one_time_cnt",
        rounded_ratio("one_time_cnt", one_n, digits_pct, 100).alias("one_time_pct"),
        rounded_ratio(F.col("star_cnt") * one_n, F.col("one_time_cnt") * star_n, digits_lift).alias("lift"))


def repeat_baseline(base: DataFrame, customers: DataFrame, orders: DataFrame,
                    status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """Repeat customers (``rfm_base``, paid) over all persons with a delivered
    order (paid or not)."""
    if facts is not None:
        persons = facts.agg(F.count_if(F.col("n_delivered") >= 1)).scalar()
    else:
        o = orders.where(F.col("status") == status).select("customer_id").distinct()
        persons = (o.join(customers.select("customer_id", PERSON), "customer_id")
                   .agg(F.count_distinct(PERSON))).scalar()
    rep = base.agg(F.count(F.lit(1)).alias("_r"))
    return rep.select(safe_ratio("_r", persons).alias("baseline_pct"))
