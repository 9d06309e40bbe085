"""Delivered sales: total, by month, by month and payment type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import money
from shoplens.operators.master import order_payment_totals


def _delivered(orders: DataFrame, status: str) -> DataFrame:
    return orders.where(F.col("status") == status).select("order_id", "purchase_timestamp")


def total_sales(orders: DataFrame, payments: DataFrame, status: str = "delivered") -> DataFrame:
    """Sum of all payments of delivered orders (summed per order first, then
    a semi join: an order key never multiplies payment rows)."""
    paid = order_payment_totals(payments).join(_delivered(orders, status), "order_id", "left_semi")
    return paid.agg(money(F.sum("order_payment_total")).alias("total_sales"))


def monthly_sales(orders: DataFrame, payments: DataFrame, status: str = "delivered") -> DataFrame:
    """Delivered sales per purchase month ``yyyy-MM``. Payments are summed per
    order first, so the join to orders is 1:1."""
    per_order = order_payment_totals(payments)
    j = _delivered(orders, status).join(per_order, "order_id")
    return (j.groupBy(F.date_format("purchase_timestamp", "yyyy-MM").alias("year_m"))
            .agg(money(F.sum("order_payment_total")).alias("sales")))


def monthly_sales_by_type(orders: DataFrame, payments: DataFrame,
                          status: str = "delivered") -> DataFrame:
    """Delivered sales per month and payment type."""
    j = payments.select("order_id", "payment_type", "payment_value").join(_delivered(orders, status), "order_id")
    return (j.groupBy(F.date_format("purchase_timestamp", "yyyy-MM").alias("year_m"), "payment_type")
            .agg(money(F.sum("payment_value")).alias("sales")))


def order_status_totals(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """All orders and delivered orders, one scan."""
    return orders.agg(F.count(F.lit(1)).alias("total_orders"),
                      F.count_if(F.col("status") == status).alias("delivered_orders"))
