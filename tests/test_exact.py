"""Rounded ratios and segment thresholds are exact."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from shoplens.functions.common import rounded_avg, rounded_ratio
from shoplens.operators import lorenz, rfm


def half_up(x: Fraction, digits: int) -> float:
    scaled = abs(x) * 10 ** digits
    whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return (1 if x >= 0 else -1) * whole / 10 ** digits


def test_exact_halves(spark):
    rng = random.Random(1)
    cases = [(87, 40), (-87, 40), (1, 8), (0, 5)] + [(rng.randint(0, 9000), rng.choice([8, 16, 40, 80, 125, 200, 2000])) for _ in range(800)]
    df = spark.createDataFrame(cases, "a long, b long")
    for digits in (0, 1, 2, 3, 4):
        for r in df.select("a", "b", rounded_ratio("a", "b", digits).alias("r")).collect():
            assert r.r == half_up(Fraction(r.a, r.b), digits), r
    assert spark.createDataFrame([(1, 0)], "a long, b long").select(rounded_ratio("a", "b", 2)).first()[0] is None


def test_average_of_money_and_counts(spark):
    df = spark.createDataFrame([(Decimal("0.05"), 3)] * 39 + [(Decimal("0.04"), -30)], "m decimal(10,2), n int")
    r = df.agg(rounded_avg("m", 4).alias("m"), rounded_avg("n", 2).alias("n")).first()
    assert r.m == float((Decimal("1.99") / 40).quantize(Decimal("0.0001"), ROUND_HALF_UP)) and r.n == 2.18   # 87 / 40


def test_average_frequency_of_87_orders(spark):
    freq = [2] * 33 + [3] * 7
    v = spark.createDataFrame([(f"p{i}", n, Decimal("1.00"), 1) for i, n in enumerate(freq)],
                              "customer_unique_id string, order_freq long, total_sales decimal(12,2), last_diff_days int")
    assert rfm.customer_type_profile(v).first().avg_order_freq == 2.18


def master(spark, sales):
    return spark.createDataFrame([(f"p{i}", Decimal(s), 1) for i, s in enumerate(sales)],
                                 "customer_unique_id string, sales decimal(22,2), delivered_order_cnt long")


def segments(spark, sales):
    out = lorenz.value_segments(lorenz.lorenz_curve(master(spark, sales)))
    return {r.customer_unique_id: r for r in out.collect()}


def test_exactly_eighty_percent_is_core(spark):
    got = segments(spark, ["0.46", "0.47", "0.48", "0.49", "0.50", "0.60"])
    assert [got[f"p{i}"].pareto_segment for i in range(6)] == ["Low", "Low", "Low", "Mid", "Core", "Core"]


def test_equal_customers_reach_the_mean(spark):
    assert {r.avg_segment for r in segments(spark, ["0.03"] * 9).values()} == {1}


def test_curve_output_is_double(spark):
    out = lorenz.curve_output(lorenz.lorenz_curve(master(spark, ["1.00", "3.00"])))
    assert dict(out.dtypes)["cum_sales"] == "double" and "total_sales" not in out.columns
    assert out.agg(F.max("cum_sales")).first()[0] == 4.0
