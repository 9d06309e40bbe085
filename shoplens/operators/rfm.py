"""RFM scoring of repeat customers and the views built on it.

Input ``V`` is :func:`shoplens.operators.master.customer_delivered_orders`
(one row per person with paid delivered orders).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import exact_avg, money, rounded_avg, safe_ratio, share_within
from shoplens.operators.master import PERSON
from shoplens.operators.selection import exact_median, with_ntile

# FIXED VALUES (labels of the reference's RFM scheme, in order).
R_LABELS = ("ACTIVE", "WARM", "WATCHING", "OUTED")      # recency quarter 1..4 of [0, max]
F_LABELS = ("F_LOW", "F_MID", "F_HIGH")                 # 2 orders / 3-4 orders / otherwise
M_LABELS = ("LIGHT", "STANDARD", "OVER", "HEAVY")       # NTILE(4) of sales, 1..4
RECENCY_BUCKETS = ("Q1", "Q2", "Q3", "Q4")
REPEAT_LABEL, ONE_TIME_LABEL = "REPEAT", "ONE_TIME"
RECENT = ("ACTIVE", "WARM")
HIGH_VALUE = (3, 4)


def one_time_count(v: DataFrame) -> DataFrame:
    return v.agg(F.count_if(F.col("order_freq") == 1).alias("one_time_customers"))


def customer_type_profile(v: DataFrame, repeat_label: str = REPEAT_LABEL,
                          one_time_label: str = ONE_TIME_LABEL) -> DataFrame:
    """One-time versus repeat customers: count, mean sales (0 decimals),
    mean order count (2), mean recency in days (0)."""
    t = F.when(F.col("order_freq") > 1, F.lit(repeat_label)).otherwise(F.lit(one_time_label))
    return v.groupBy(t.alias("customer_type")).agg(
        F.count(F.lit(1)).alias("customer_cnt"),
        rounded_avg("total_sales", 0).alias("avg_sales"),
        rounded_avg("order_freq", 2).alias("avg_order_freq"),
        rounded_avg("last_diff_days", 0).alias("avg_recency"))


def rfm_base(v: DataFrame, min_orders: int = 2) -> DataFrame:
    """Repeat customers (``order_freq >= min_orders``) + sales per order."""
    return (v.where(F.col("order_freq") >= min_orders)
            .withColumn("per_sales", safe_ratio("total_sales", "order_freq")))


def frequency_distribution(base: DataFrame, digits: int = 1) -> DataFrame:
    counts = base.groupBy("order_freq").agg(F.count(F.lit(1)).alias("cnt"))
    return share_within(counts, "cnt", None, "pct", digits, scale=100)


def _max_recency(base: DataFrame):
    """Largest recency of the base, as a scalar subquery column."""
    return base.agg(F.max("last_diff_days").cast("bigint")).scalar()


def _recency_case(labels, n: int, max_d) -> F.Column:
    """Equal-width bins of [0, max]: bin i when days*n <= max*i (exact
    integer arithmetic; an edge belongs to the lower bin)."""
    d, m = F.col("last_diff_days").cast("bigint"), max_d
    expr = None
    for i, label in enumerate(labels[:-1], start=1):
        cond = d * F.lit(n) <= m * F.lit(i)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def recency_bins(base: DataFrame, labels=RECENCY_BUCKETS, digits: int | None = 3) -> DataFrame:
    """Counts per equal-width recency bin and their share."""
    b = base.select(_recency_case(labels, len(labels), _max_recency(base)).alias("recency_bucket"))
    counts = b.groupBy("recency_bucket").agg(F.count(F.lit(1)).alias("cnt"))
    return share_within(counts, "cnt", None, "pct", digits)


def mean_median(base: DataFrame, col: str = "total_sales") -> DataFrame:
    """Mean and exact median (mean of the two middle values for an even count)."""
    mean = base.agg(exact_avg(col).alias("sales_avg"))
    med = exact_median(base, col, PERSON, "sales_median")
    return mean.select("sales_avg", med.scalar().alias("sales_median"))   # scalar subquery


def with_m_bucket(base: DataFrame, tiles: int = 4) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY total_sales, person)`` as ``m_bucket``."""
    return with_ntile(base, "total_sales", PERSON, tiles, "m_bucket")


def ntile_summary(base: DataFrame, tiles: int = 4) -> DataFrame:
    """Size and sales range of each NTILE bucket of sales. Accepts
    ``rfm_scored`` output (its ``m_bucket`` is reused) or the RFM base."""
    b = base if "m_bucket" in base.columns else with_m_bucket(base, tiles)
    return b.groupBy("m_bucket").agg(
        F.count(F.lit(1)).alias("cnt"),
        money(F.min("total_sales")).alias("min_sales"),
        money(F.max("total_sales")).alias("max_sales"),
        rounded_avg("total_sales", 0).alias("avg_sales"))


def rfm_scored(base: DataFrame) -> DataFrame:
    """R, F and M labels per repeat customer, and ``persona`` = R-F-M."""
    b = with_m_bucket(base, 4)
    r = _recency_case(R_LABELS, len(R_LABELS), _max_recency(base))
    f = (F.when(F.col("order_freq") == 2, F.lit(F_LABELS[0]))
         .when(F.col("order_freq").between(3, 4), F.lit(F_LABELS[1]))
         .otherwise(F.lit(F_LABELS[2])))
    m = None
    for i, label in enumerate(M_LABELS, start=1):
        m = F.when(F.col("m_bucket") == i, F.lit(label)) if m is None else m.when(F.col("m_bucket") == i, F.lit(label))
    s = b.select(PERSON, "last_order", "last_diff_days", "order_freq", "total_sales",
                 r.alias("r_segment"), f.alias("f_segment"), "m_bucket", m.alias("m_segment"))
    return s.withColumn("persona", F.concat(F.col("r_segment"), F.lit("-"), F.col("f_segment"),
                                           F.lit("-"), F.col("m_segment")))


def scored_output(scored: DataFrame) -> DataFrame:
    return scored.withColumn("total_sales", money("total_sales"))


def persona_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("persona").agg(F.count(F.lit(1)).alias("cnt"))


def bcg_quadrant_col() -> F.Column:
    recent = F.col("r_segment").isin(*RECENT)
    high = F.col("m_bucket").isin(*HIGH_VALUE)
    return (F.when(recent & high, F.lit("STAR"))
            .when(recent & F.col("m_bucket").isin(1, 2), F.lit("QUESTION_MARK"))
            .when(F.col("r_segment").isin("WATCHING", "OUTED") & high, F.lit("CASH_COW"))
            .otherwise(F.lit("DOG")))


def bcg_quadrants(scored: DataFrame) -> DataFrame:
    """Recency (ACTIVE/WARM = recent) x value (M bucket 3-4 = high):
    STAR, QUESTION_MARK, CASH_COW, DOG, with mean order count."""
    return scored.groupBy(bcg_quadrant_col().alias("bcg_quadrant")).agg(
        F.count(F.lit(1)).alias("cnt"),
        rounded_avg("order_freq", 2).alias("avg_f"))


def one_time_delivered_orders(customers: DataFrame, orders: DataFrame,
                              status: str = "delivered", facts: DataFrame | None = None) -> DataFrame:
    """Delivered orders (paid or not) of persons with fewer than two of them."""
    from shoplens.operators.segments import orders_per_person
    per_person = orders_per_person(customers, orders, status, facts)
    return (per_person.where(F.col("order_count") < 2)
            .agg(F.sum("order_count").cast("bigint").alias("one_time_orders")))


def rfm_exploration_base(v: DataFrame, customers: DataFrame, orders: DataFrame,
                         status: str = "delivered", min_orders: int = 2,
                         facts: DataFrame | None = None) -> DataFrame:
    """The exploratory variant of :func:`rfm_base`: who is a repeat customer
    is decided on delivered orders *before* the payment join, while the RFM
    values come after it. A person with two delivered orders, one unpaid, is
    therefore kept with ``order_freq = 1`` (and scores ``F_HIGH`` by the
    frequency rule's ELSE branch)."""
    from shoplens.operators.segments import orders_per_person
    eligible = (orders_per_person(customers, orders, status, facts)
                .where(F.col("order_count") >= min_orders).select(PERSON))
    return (v.join(eligible, PERSON, "left_semi")
            .withColumn("per_sales", safe_ratio("total_sales", "order_freq")))


def delivered_recency(customers: DataFrame, orders: DataFrame, as_of: str,
                      status: str = "delivered", min_orders: int = 2,
                      facts: DataFrame | None = None) -> DataFrame:
    """Persons with at least ``min_orders`` delivered orders (paid or not) and
    the days from their last delivered purchase to ``as_of`` (the recency
    base of the exploratory script: no payment join)."""
    if facts is not None:
        per_person = facts.select(PERSON, F.col("n_delivered").alias("_n"),
                                  F.col("last_delivered_ts").alias("_last"))
    else:
        per_id = (orders.where(F.col("status") == status)
                  .groupBy("customer_id").agg(F.count("order_id").alias("_n"),
                                              F.max("purchase_timestamp").alias("_last")))
        per_person = (per_id.join(customers.select("customer_id", PERSON), "customer_id")
                      .groupBy(PERSON).agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last")))
    return (per_person.where(F.col("_n") >= min_orders)
            .select(PERSON, F.datediff(F.lit(as_of).cast("date"), F.col("_last").cast("date"))
                    .alias("last_diff_days")))
