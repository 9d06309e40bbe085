"""Invariants of SURVEY §5.5 on the driver data (sf0.01)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shoplens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def q(spark, name):
    return QUERIES[name](spark, SF)


def test_unrounded_shares_add_up_to_one(spark):
    piv = q(spark, "sequence_category_pivot")
    for t in (1, 2, 3, 4):
        total = piv.agg(F.sum(f"order_{t}")).collect()[0][0]
        assert total is None or abs(total - 1.0) < 1e-9


def test_ntile_sizes_differ_by_at_most_one(spark):
    sizes = [r.cnt for r in q(spark, "ntile_summary").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_lorenz_curve_ends_at_one(spark):
    r = q(spark, "lorenz_curve").agg(F.max("revenue_ratio"), F.max("customer_ratio"),
                                     F.min("distance")).collect()[0]
    assert abs(r[0] - 1.0) < 1e-12 and r[1] == 1.0 and r[2] >= -1e-12


def test_funnel_is_monotone(spark):
    st = {r.stage: r.customer_cnt for r in q(spark, "funnel_stages").collect()}
    assert st["order_customers"] >= st["delivered_customers"] >= st["repeat_customers"]
    assert st["repeat_attempt_customers"] >= st["repeat_customers"]


def test_memberships_identity(spark):
    r = q(spark, "cohort_match_report").collect()[0]
    assert r.total_category_memberships == r.matched_customers + r.excess_from_multi
    assert r.star_total == r.matched_customers + r.lost_customers
    lift = q(spark, "cohort_lift").agg(F.sum("star_cnt")).collect()[0][0]
    assert lift == r.total_category_memberships


def test_master_counts_agree(spark):
    m = q(spark, "customer_master")
    v = q(spark, "customer_delivered_orders")
    assert m.where("active_customer = 1").count() == v.count()
    assert m.where("repeat_customer = 1").count() == q(spark, "rfm_base").count()
