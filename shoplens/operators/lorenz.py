"""Lorenz curve of customer sales and the segments cut from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import as_double, money, safe_ratio
from shoplens.operators.master import PERSON
from shoplens.operators.ranking import drop_internal, global_order, range_running_sum
from shoplens.plans.cache import keep


def lorenz_curve(master: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per customer with >= 1 paid delivered order, ascending by sales:

    * ``cum_sales``: running sum with peers (equal sales share one value);
    * ``revenue_ratio`` = cum_sales / total; ``customer_cnt`` = row number
      (ties broken by person id); ``customer_ratio`` = customer_cnt / N;
    * ``lorenz_slope`` = sales / mean sales; ``distance`` = customer_ratio - revenue_ratio.

    Money stays DECIMAL, with the totals ``total_sales`` and ``person_cnt`` on
    every row for exact comparisons; :func:`curve_output` is the report.

    No single-partition window: see :mod:`shoplens.operators.ranking`.
    """
    base = keep(master.where(F.col("delivered_order_cnt") >= 1).select(PERSON, "sales"))
    go = global_order(base, ["sales", PERSON], ["sales"], buckets=buckets)
    df = range_running_sum(go, ["sales"], "sales", "cum_sales")
    n = go.totals.select("_n").scalar()                     # scalar subqueries over
    total = go.totals.select("_total_sales").scalar()       # the k-row bucket stats
    revenue_ratio = safe_ratio("cum_sales", total)
    customer_ratio = safe_ratio("_rn", n)
    out = df.select(
        PERSON,
        "sales", "cum_sales", total.alias("total_sales"), n.alias("person_cnt"),
        revenue_ratio.alias("revenue_ratio"),
        F.col("_rn").cast("bigint").alias("customer_cnt"),
        customer_ratio.alias("customer_ratio"),
        F.try_divide(as_double("sales"), safe_ratio(total, n)).alias("lorenz_slope"),
        (customer_ratio - revenue_ratio).alias("distance"))
    return drop_internal(out)


def curve_output(curve: DataFrame) -> DataFrame:
    """The curve with money as DOUBLE, without the totals."""
    return curve.withColumns({"sales": money("sales"), "cum_sales": money("cum_sales")}) \
        .drop("total_sales", "person_cnt")


def lorenz_peak(curve: DataFrame) -> DataFrame:
    """The customer where the curve is farthest below the diagonal
    (largest ``distance``; ties go to the smaller ``customer_cnt``).
    One aggregate row, computed with partial aggregation."""
    best = curve.agg(F.max(F.struct(
        F.col("distance").alias("distance"), (-F.col("customer_cnt")).alias("neg_cnt"),
        F.col(PERSON).alias(PERSON), money("sales").alias("sales"),
        F.col("customer_ratio").alias("customer_ratio"), F.col("revenue_ratio").alias("revenue_ratio"),
        F.col("lorenz_slope").alias("lorenz_slope"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select(
        F.col(f"b.{PERSON}").alias(PERSON), "b.sales", "b.customer_ratio", "b.revenue_ratio",
        "b.lorenz_slope", "b.distance")


def value_segments(curve: DataFrame, cut: float | None = None, core: float = 0.8,
                   mid: float = 0.5) -> DataFrame:
    """Three segmentations of the Lorenz rows:

    * ``structure_segment``: 1 above the cut point on the customer axis
      (default cut: ``customer_ratio`` at :func:`lorenz_peak`), else 0;
    * ``avg_segment``: 1 if sales >= mean sales;
    * ``pareto_segment`` on the ascending cumulative revenue share:
      'Core' from ``core`` on, 'Mid' from ``mid`` on, else 'Low'.

    The last two compare DECIMAL products, so exact hits count as reached.
    """
    def reached(share: float) -> F.Column:
        parts = F.lit(round(share * 10_000)).cast("decimal(5,0)")
        return F.col("cum_sales") * F.lit(10_000) >= F.col("total_sales") * parts
    if cut is None:
        cut_col = lorenz_peak(curve).select("customer_ratio").scalar()   # scalar subquery
    else:
        cut_col = F.lit(float(cut))
    out = curve.select(
        PERSON, money("sales").alias("sales"), "customer_ratio", "revenue_ratio", "lorenz_slope", "distance",
        F.when(F.col("customer_ratio") <= cut_col, F.lit(0)).otherwise(F.lit(1)).alias("structure_segment"),
        F.when(F.col("sales") * F.col("person_cnt") >= F.col("total_sales"), F.lit(1)).otherwise(F.lit(0)).alias("avg_segment"),
        F.when(reached(core), F.lit("Core"))
        .when(reached(mid), F.lit("Mid")).otherwise(F.lit("Low")).alias("pareto_segment"))
    return out
