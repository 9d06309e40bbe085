"""One-row-per-customer tables (the person is ``customer_unique_id``).

Plan shape used throughout: aggregate the fact side to the join key first
(payments per order, orders per customer id), so every join is 1:1 or N:1 on
already-reduced rows. A customer with a huge share of the orders then costs
one partial-aggregation row per map task, not a skewed join partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import flag
from shoplens.functions.joins import gathered

PERSON = "customer_unique_id"


def order_payment_totals(payments: DataFrame) -> DataFrame:
    """Payments are 1:N per order: sum them per order before any join.

    Idempotent: a frame that already holds ``order_payment_total`` per order
    (e.g. a persisted result of this function) is passed through.
    """
    if "order_payment_total" in payments.columns:
        return payments.select("order_id", "order_payment_total")
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("order_payment_total"))


def order_type_totals(payments: DataFrame) -> DataFrame:
    """Payments summed per order and payment type, under the columns of
    ``payments``: whatever sums payments per order, month or type can read
    this instead of the raw rows."""
    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("order_id", "payment_type").agg(F.sum("payment_value").alias("payment_value"))
    rows = payments.select("order_id", "payment_type", "payment_value")
    kind = total(rows).schema["payment_value"].dataType
    return total(gathered(rows, "order_id", total)).withColumn("payment_value", F.col("payment_value").cast(kind))


def latest_row_per_key(df: DataFrame, key: str | list[str], order_cols: list[str],
                       attrs: list[str]) -> DataFrame:
    """Attributes of the row with the largest ``order_cols`` per key
    (``ROW_NUMBER() OVER (PARTITION BY key ORDER BY order_cols DESC) = 1``).

    Written as ``max(struct(order_cols, attrs))``: a hash aggregate with
    map-side partial aggregation, so a key holding a third of all rows is
    reduced inside every map task instead of sorted in one window task.
    ``order_cols`` should be unique per key (include the row id).
    """
    keys = [key] if isinstance(key, str) else list(key)
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                      *[F.col(a).alias(a) for a in attrs])
    return (df.groupBy(*keys).agg(F.max(packed).alias("_latest"))
            .select(*keys, *[F.col("_latest")[a].alias(a) for a in attrs]))


def customer_order_facts(orders: DataFrame, payments: DataFrame,
                         status: str = "delivered") -> DataFrame:
    """Everything the customer-level views need, per customer id, in one pass:
    one scan of ``orders``, one join to per-order payment totals, one hash
    aggregation with conditional aggregates (map-side partial aggregation, so
    a customer with a huge share of the orders is reduced in every map task).

    ``paid`` means the order has at least one payment row (inner-join
    semantics of the original views).
    """
    paid = order_payment_totals(payments).withColumn("_has_pay", F.lit(True))
    o = (orders.select("order_id", "customer_id", "status", "purchase_timestamp")
         .join(paid, "order_id", "left"))
    ts = F.col("purchase_timestamp")
    delivered = F.col("status") == status
    paid_del = delivered & F.col("_has_pay").isNotNull()
    return o.groupBy("customer_id").agg(
        F.count("order_id").alias("n_orders"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.when(delivered, F.col("order_id"))).alias("n_delivered"),
        F.max(F.when(delivered, ts)).alias("last_delivered_ts"),
        F.min(F.when(delivered, F.struct(ts.alias("t"), F.col("order_id").alias("oid"))))
        .alias("first_delivered"),
        F.count(F.when(paid_del, F.col("order_id"))).alias("n_paid"),
        F.max(F.when(paid_del, ts)).alias("last_paid_ts"),
        F.sum(F.when(paid_del, F.col("order_payment_total"))).alias("paid_sales"))


def person_order_facts(customers: DataFrame, orders: DataFrame, payments: DataFrame,
                       status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """Per person (``customer_unique_id``) with at least one order: the
    latest customer id and address (latest purchase, then larger customer
    id), order counts and dates for all / delivered / paid delivered orders,
    paid sales, and the first delivered order (time, order id).

    The per-customer-id facts join customers 1:1, then reduce per person.
    Pass a persisted ``facts`` (this function's own result) to share it.
    """
    if facts is not None:
        return facts
    f = customer_order_facts(orders, payments, status)
    c = customers.select("customer_id", PERSON, "state", "clean_city", "zip_code_prefix")
    latest = F.max(F.struct(F.col("last_ts").alias("t"), F.col("customer_id").alias("cid"),
                            F.col("state").alias("state"), F.col("clean_city").alias("clean_city"),
                            F.col("zip_code_prefix").alias("zip_code_prefix")))
    return f.join(c, "customer_id").groupBy(PERSON).agg(
        latest.alias("_l"),
        F.sum("n_orders").cast("bigint").alias("order_cnt"),
        F.min("first_ts").alias("first_order"),
        F.max("last_ts").alias("last_order"),
        F.sum("n_delivered").cast("bigint").alias("n_delivered"),
        F.max("last_delivered_ts").alias("last_delivered_ts"),
        F.min("first_delivered").alias("first_delivered"),
        F.sum("n_paid").cast("bigint").alias("n_paid"),
        F.max("last_paid_ts").alias("last_paid_ts"),
        F.sum("paid_sales").alias("paid_sales"))


def one_customer(customers: DataFrame, orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per person with at least one order: latest customer id and
    address (latest purchase, then larger customer id), order count, first and
    last purchase."""
    if facts is None:
        no_payments = (orders.select("order_id", F.lit(None).cast("decimal(12,2)").alias("payment_value"))
                       .where(F.lit(False)))                  # empty; the optimizer drops the join
        facts = person_order_facts(customers, orders, no_payments)
    return facts.select(
        F.col("_l.cid").alias("customer_id"), PERSON,
        F.col("_l.state").alias("state"), F.col("_l.clean_city").alias("clean_city"),
        F.col("_l.zip_code_prefix").alias("zip_code_prefix"),
        "order_cnt", "first_order", "last_order")


def delivered_summary(customers: DataFrame, orders: DataFrame, payments: DataFrame,
                      status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """Per person: number of delivered orders that have a payment, and their
    paid sales (orders without any payment drop out: inner join)."""
    pf = person_order_facts(customers, orders, payments, status, facts)
    return pf.where(F.col("n_paid") >= 1).select(
        PERSON, F.col("n_paid").alias("delivered_order_cnt"), F.col("paid_sales").alias("sales"))


def customer_master(customers: DataFrame, orders: DataFrame, payments: DataFrame,
                    status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """``one_customer`` + delivered summary + 0/1 flags:
    active (>= 1 paid delivered order), repeat (>= 2), interest (>= 2 orders of any status)."""
    pf = person_order_facts(customers, orders, payments, status, facts)
    dcnt = F.col("n_paid")
    return pf.select(
        F.col("_l.cid").alias("customer_id"), PERSON,
        F.col("_l.state").alias("state"), F.col("_l.clean_city").alias("clean_city"),
        F.col("_l.zip_code_prefix").alias("zip_code_prefix"),
        "order_cnt", "first_order", "last_order",
        dcnt.alias("delivered_order_cnt"),
        F.coalesce(F.col("paid_sales"), F.lit(0).cast(pf.schema["paid_sales"].dataType)).alias("sales"),
        flag(dcnt >= 1).alias("active_customer"),
        flag(dcnt >= 2).alias("repeat_customer"),
        flag(F.col("order_cnt") >= 2).alias("interest_customer"))


def customer_delivered_orders(customers: DataFrame, orders: DataFrame, payments: DataFrame,
                              as_of: str, status: str = "delivered",
                              facts: DataFrame | None = None) -> DataFrame:
    """Per person over delivered orders that have a payment: order count,
    last purchase, days from it to ``as_of`` (date parts only), paid sales."""
    pf = person_order_facts(customers, orders, payments, status, facts)
    return pf.where(F.col("n_paid") >= 1).select(
        PERSON, F.col("n_paid").alias("order_freq"), F.col("last_paid_ts").alias("last_order"),
        F.datediff(F.lit(as_of).cast("date"), F.col("last_paid_ts").cast("date")).alias("last_diff_days"),
        F.col("paid_sales").alias("total_sales"))
