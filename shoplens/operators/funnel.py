"""Purchase funnel over the customer master: order -> delivered -> repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import rounded_ratio

STAGES = (("order_customers", 1), ("delivered_customers", 2),
          ("repeat_attempt_customers", 3), ("repeat_customers", 4))


def funnel_rates(master: DataFrame, digits: int = 4) -> DataFrame:
    """Counts and rates in one pass. Denominators by name:
    delivered_customer_rate and repeated_attempt_rate over all order customers,
    repeat_rate over delivered customers, interest_to_repeat_rate over
    customers with two or more orders. A zero denominator gives NULL."""
    agg = master.agg(
        F.count(F.lit(1)).alias("order_customer_cnt"),
        F.sum("active_customer").cast("bigint").alias("delivered_customer_cnt"),
        F.sum("repeat_customer").cast("bigint").alias("repeat_customer_cnt"),
        F.sum("interest_customer").cast("bigint").alias("repeated_attempt_customer_cnt"))
    return agg.select(
        "*",
        rounded_ratio("delivered_customer_cnt", "order_customer_cnt", digits)
        .alias("delivered_customer_rate"),
        rounded_ratio("repeat_customer_cnt", "delivered_customer_cnt", digits)
        .alias("repeat_rate"),
        rounded_ratio("repeated_attempt_customer_cnt", "order_customer_cnt", digits)
        .alias("repeated_attempt_rate"),
        rounded_ratio("repeat_customer_cnt", "repeated_attempt_customer_cnt", digits)
        .alias("interest_to_repeat_rate"))


def funnel_stages(master: DataFrame) -> DataFrame:
    """The four stage counts as rows (one scan + ``stack``, not four scans)."""
    agg = master.agg(
        F.count(F.lit(1)).cast("bigint").alias("s1"),
        F.sum("active_customer").cast("bigint").alias("s2"),
        F.sum("interest_customer").cast("bigint").alias("s3"),
        F.sum("repeat_customer").cast("bigint").alias("s4"))
    (n1, o1), (n2, o2), (n3, o3), (n4, o4) = STAGES
    return agg.selectExpr(
        f"stack(4, '{n1}', {o1}, s1, '{n2}', {o2}, s2, '{n3}', {o3}, s3, '{n4}', {o4}, s4) "
        "as (stage, stage_order, customer_cnt)")
