"""Order sequences of repeat customers: order number, gap to the previous
order, change of order value, and the category mix per order number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import money, rounded_avg, share_within
from shoplens.functions.joins import spread_join
from shoplens.operators.category import order_category_counts
from shoplens.operators.master import PERSON, order_payment_totals
from shoplens.operators.ranking import numbered
from shoplens.plans.cache import keep


def repeat_customer_orders(master: DataFrame, customers: DataFrame, orders: DataFrame,
                           status: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """All orders (any status unless ``status`` is given) of persons flagged
    as repeat customers in the master; ``more``: further columns to keep."""
    repeat = master.where(F.col("repeat_customer") == 1).select(PERSON)
    ids = customers.select("customer_id", PERSON).join(repeat, PERSON, "left_semi")
    o = orders
    if status is not None:
        o = o.where(F.col("status") == status)
    return spread_join(o.select("order_id", "customer_id", "purchase_timestamp", "status", *more), ids, "customer_id",
                       F.col("order_id"))


def order_sequence(master: DataFrame, customers: DataFrame, orders: DataFrame,
                   payments: DataFrame, status: str | None = None,
                   buckets: int | None = None) -> DataFrame:
    """One row per order of a repeat customer, numbered by (purchase time,
    order id) within the person, with the previous order's sales and time.

    Unpaid orders stay with NULL sales (left join). The numbering and the
    lags come from :func:`numbered` over (person, time, order id), so a
    person with a huge number of orders is split over several tasks. Relies
    on ``order_id`` being the key of ``orders`` (checked by the integrity
    report), which makes (person, time, order id) unique.
    """
    # Payments first: both sides may lie by order id (bucketed views), and no other join has moved the orders yet.
    sales = orders.join(order_payment_totals(payments).withColumnRenamed("order_payment_total", "order_sales"), "order_id", "left")
    o = repeat_customer_orders(master, customers, sales, status, ("order_sales",))
    o = keep(o.select(PERSON, "order_id", "purchase_timestamp", "status", "order_sales"))
    seq = numbered(o, PERSON, ["purchase_timestamp", "order_id"], "order_times", ["order_sales", "purchase_timestamp"],
                   buckets=buckets)
    return seq.select(
        PERSON, "order_id", "purchase_timestamp", "status", "order_sales",
        F.col("order_times").cast("int").alias("order_times"),
        F.col("prev_order_sales"), F.col("prev_purchase_timestamp"),
        F.datediff(F.col("purchase_timestamp").cast("date"),
                   F.col("prev_purchase_timestamp").cast("date")).alias("days_from_prev_order"),
        (F.col("order_sales") - F.col("prev_order_sales")).alias("diff_order_sales"))


def sequence_stats(seq: DataFrame) -> DataFrame:
    """Per order number: orders, average/min/max days since the previous order
    (the first order has none), average order sales."""
    return seq.groupBy("order_times").agg(
        F.count(F.lit(1)).alias("order_cnt"),
        rounded_avg("days_from_prev_order", 2).alias("avg_days_from_prev_order"),
        F.min("days_from_prev_order").alias("min_days_from_prev_order"),
        F.max("days_from_prev_order").alias("max_days_from_prev_order"),
        rounded_avg("order_sales", 2).alias("avg_order_sales"))


def _sequence_category_counts(seq: DataFrame, items: DataFrame, products: DataFrame,
                              dictionary: DataFrame, times, unknown: str,
                              summary: DataFrame | None = None) -> DataFrame:
    s = seq.where(F.col("order_times").isin(list(times))).select("order_id", "order_times")
    per_order = order_category_counts(items, products, dictionary, unknown, summary)
    return (per_order.join(s, "order_id")
            .groupBy("order_times", "category_group")
            .agg(F.sum("_items").cast("bigint").alias("cnt")))


def sequence_category_mix(seq: DataFrame, items: DataFrame, products: DataFrame,
                          dictionary: DataFrame, times=(1, 2, 3, 4), unknown: str = "drop",
                          digits: int | None = 4, summary: DataFrame | None = None) -> DataFrame:
    """Item rows per (order number, category group) and their share within
    the order number. Unknown categories are dropped by default."""
    counts = _sequence_category_counts(seq, items, products, dictionary, times, unknown, summary)
    return share_within(counts, "cnt", ["order_times"], "ratio", digits)


def sequence_category_pivot(seq: DataFrame, items: DataFrame, products: DataFrame,
                            dictionary: DataFrame, times=(1, 2, 3, 4),
                            unknown: str = "keep", summary: DataFrame | None = None) -> DataFrame:
    """Category group x order number (1..4) of unrounded shares; unknown
    categories kept as 'Unknown'. NULL where a group has no item."""
    counts = _sequence_category_counts(seq, items, products, dictionary, times, unknown, summary)
    shares = share_within(counts, "cnt", ["order_times"], "ratio", None)
    return (shares.groupBy("category_group")
            .pivot("order_times", list(times)).agg(F.max("ratio"))
            .select("category_group", *[F.col(str(t)).alias(f"order_{t}") for t in times]))


def sequence_output(seq: DataFrame) -> DataFrame:
    """``order_sequence`` with money as double (the output edge)."""
    return seq.select(
        PERSON, "order_id", "purchase_timestamp", "status", money("order_sales").alias("order_sales"),
        "order_times", money("prev_order_sales").alias("prev_order_sales"),
        "prev_purchase_timestamp", "days_from_prev_order",
        money("diff_order_sales").alias("diff_order_sales"))
