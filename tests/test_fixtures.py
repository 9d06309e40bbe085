"""Hand-made micro-tables for cases the driver data lacks (FIXTURES.md §3)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from shoplens.functions.text import clean_category, clean_city
from shoplens.operators import (category, cohort, first_purchase, funnel, lorenz, master, rfm,
                                segments, sequence)
from shoplens.sources.files import load_csv
from shop_tables import make_tables, money, ts

DICT = [("brinquedos", " Toys\r"), ("cama", "bed_bath_table"), ("livros", "books_technical")]
PRODUCTS = [("p_toy", "brinquedos"), ("p_bed", "cama"), ("p_book", "livros"), ("p_x", "nao_existe")]


def test_drifted_address_latest_wins(spark):
    t = make_tables(spark,
                    customers=[("c1", "u1", "01001", "Sao Paulo", "SP"), ("c2", "u1", "20000", "Rio", "RJ")],
                    orders=[("o1", "c1", "delivered", ts("2018-01-01 10:00:00")),
                            ("o2", "c2", "delivered", ts("2018-03-01 10:00:00"))])
    rows = master.one_customer(t.customers, t.orders).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.customer_id, r.state, r.clean_city, r.zip_code_prefix, r.order_cnt) == ("c2", "RJ", "rio", "20000", 2)
    assert r.first_order == ts("2018-01-01 10:00:00") and r.last_order == ts("2018-03-01 10:00:00")


def test_latest_tie_higher_customer_id(spark):
    same = ts("2018-05-05 12:00:00")
    t = make_tables(spark,
                    customers=[("c1", "u1", "01001", "A", "SP"), ("c9", "u1", "02002", "B", "MG")],
                    orders=[("o1", "c1", "delivered", same), ("o2", "c9", "delivered", same)])
    r = master.one_customer(t.customers, t.orders).collect()[0]
    assert r.customer_id == "c9" and r.state == "MG"


def _unpaid(spark):
    return make_tables(spark,
                       customers=[("c1", "u1", "01001", "A", "SP")],
                       orders=[("o1", "c1", "delivered", ts("2018-01-01 00:00:00")),
                               ("o2", "c1", "delivered", ts("2018-02-01 00:00:00"))],
                       payments=[("o1", 1, "credit_card", money(10))])


def test_unpaid_delivered(spark):
    t = _unpaid(spark)
    m = master.customer_master(t.customers, t.orders, t.payments)
    r = m.collect()[0]
    assert r.delivered_order_cnt == 1 and r.repeat_customer == 0 and r.active_customer == 1
    assert r.interest_customer == 1
    v = master.customer_delivered_orders(t.customers, t.orders, t.payments, "2018-11-12")
    assert v.collect()[0].order_freq == 1
    assert rfm.rfm_base(v).count() == 0
    # the exploratory rule keeps the person (two delivered orders) with freq 1
    assert rfm.rfm_exploration_base(v, t.customers, t.orders).collect()[0].order_freq == 1
    dist = segments.order_count_distribution(m, t.customers, t.orders).collect()
    assert [(d.order_count, d.customer_cnt) for d in dist] == [(2, 1)]


def test_never_delivered_kept_with_zeros(spark):
    t = make_tables(spark, customers=[("c1", "u1", "01001", "A", "SP")],
                    orders=[("o1", "c1", "canceled", ts("2018-01-01 00:00:00"))],
                    payments=[("o1", 1, "voucher", money(5))])
    r = master.customer_master(t.customers, t.orders, t.payments).collect()[0]
    assert (r.delivered_order_cnt, float(r.sales), r.active_customer, r.repeat_customer,
            r.interest_customer) == (0, 0.0, 0, 0, 0)


def test_split_payment_summed_once(spark):
    t = make_tables(spark, customers=[("c1", "u1", "01001", "A", "SP")],
                    orders=[("o1", "c1", "delivered", ts("2018-01-01 00:00:00"))],
                    payments=[("o1", 1, "credit_card", money(10)), ("o1", 2, "voucher", money(5)),
                              ("o1", 3, "voucher", money(2.5))])
    v = master.customer_delivered_orders(t.customers, t.orders, t.payments, "2018-11-12").collect()[0]
    assert v.order_freq == 1 and float(v.total_sales) == 17.5
    d = master.delivered_summary(t.customers, t.orders, t.payments).collect()[0]
    assert d.delivered_order_cnt == 1 and float(d.sales) == 17.5


def _first_order_tables(spark):
    same = ts("2018-01-01 09:00:00")
    return make_tables(
        spark,
        customers=[("c1", "u1", "01001", "A", "SP"), ("c2", "u2", "01001", "A", "SP")],
        orders=[("o2", "c1", "delivered", same), ("o1", "c1", "delivered", same),
                ("o3", "c2", "delivered", ts("2018-02-01 00:00:00"))],
        payments=[("o1", 1, "x", money(1)), ("o2", 1, "x", money(1)), ("o3", 1, "x", money(1))],
        items=[("o1", 1, "p_toy", money(1)), ("o1", 2, "p_x", money(1)), ("o2", 1, "p_bed", money(1)),
               ("o3", 1, "p_bed", money(1)), ("o3", 2, "p_book", money(1))],
        products=PRODUCTS, dictionary=DICT)


def test_first_order_tie_lower_order_id(spark):
    t = _first_order_tables(spark)
    fo = {r.customer_unique_id: r.order_id
          for r in first_purchase.first_delivered_order(t.customers, t.orders).collect()}
    assert fo == {"u1": "o1", "u2": "o3"}
    numbered = cohort.first_order(t.customers, t.orders).where(F.col("fo_num") == 1).collect()
    assert {r.customer_unique_id: r.order_id for r in numbered} == fo


def test_two_items_one_unknown_is_single_item(spark):
    t = _first_order_tables(spark)
    foi = first_purchase.first_order_items(t.customers, t.orders, t.items, t.products, t.dictionary)
    mix = {r.category_group: r.cnt for r in first_purchase.single_item_first_mix(foi).collect()}
    # u1's first order o1 has a toy and an unknown product: counts as single (toy);
    # u2's first order has two known items: not single
    assert mix == {"Sports & Leisure": 1}


def test_unknown_category_drop_or_keep(spark):
    t = _first_order_tables(spark)
    kept = category.item_categories(t.items, t.products, t.dictionary, "keep")
    dropped = category.item_categories(t.items, t.products, t.dictionary, "drop")
    assert kept.count() == 5 and dropped.count() == 4
    assert kept.where(F.col("category_group") == "Unknown").count() == 1


def test_first_order_two_categories_counts_in_both(spark):
    t = _first_order_tables(spark)
    cats = cohort.first_categories(t.customers, t.orders, t.items, t.products, t.dictionary)
    cohort_df = spark.createDataFrame([("u2",)], "customer_unique_id string")
    r = cohort.cohort_match_report(cats, cohort_df).collect()[0]
    assert (r.star_total, r.matched_customers, r.lost_customers, r.multi_category_customers,
            r.total_category_memberships, r.excess_from_multi) == (1, 1, 0, 1, 2, 1)
    v = master.customer_delivered_orders(t.customers, t.orders, t.payments, t.as_of)
    lift = {r.category_group: r.star_cnt for r in cohort.cohort_lift(cats, cohort_df, v).collect()}
    # u1 (two paid orders, not in the cohort) is neither STAR nor one-time: dropped
    assert lift == {"Home & Living": 1, "Books & Media": 1}


def test_dirty_category_and_null(spark):
    rows = spark.createDataFrame([(" Toys\r",), (None,), ("FOOD\n",)], "x string")
    out = [r[0] for r in rows.select(clean_category("x")).collect()]
    assert out == ["toys", None, "food"]
    from shoplens.functions.categories import map_category
    d = spark.createDataFrame([("a", " Toys\r"), ("b", None), ("c", "nope")],
                              "product_category string, product_category_eng string")
    got = {r.product_category: r.category_group for r in map_category(d).collect()}
    assert got == {"a": "Sports & Leisure", "b": "Others", "c": "Others"}


def test_city_apostrophe(spark):
    df = spark.createDataFrame([("D'Oeste",), ("  Sao Paulo ",)], "c string")
    assert [r[0] for r in df.select(clean_city("c")).collect()] == ["d oeste", "sao paulo"]


def test_equal_sales_share_running_sum(spark):
    cust = [(f"c{i}", f"u{i}", "01001", "A", "SP") for i in range(4)]
    orders = [(f"o{i}", f"c{i}", "delivered", ts("2018-01-01 00:00:00")) for i in range(4)]
    pays = [("o0", 1, "x", money(5)), ("o1", 1, "x", money(10)), ("o2", 1, "x", money(10)),
            ("o3", 1, "x", money(10))]
    t = make_tables(spark, cust, orders, pays)
    m = master.customer_master(t.customers, t.orders, t.payments)
    for b in (1, 2):
        z = {r.customer_unique_id: r for r in lorenz.lorenz_curve(m, buckets=b).collect()}
        assert z["u0"].cum_sales == 5.0
        assert {z[u].cum_sales for u in ("u1", "u2", "u3")} == {35.0}
        assert sorted(z[u].customer_cnt for u in z) == [1, 2, 3, 4]
        assert z["u3"].revenue_ratio == 1.0 and z["u3"].customer_ratio == 1.0


def _rfm_tables(spark, days):
    """One repeat customer per entry of ``days`` (two orders each, the last
    ``d`` days before as_of); sales grow with the index."""
    cust, orders, pays = [], [], []
    for i, d in enumerate(days):
        cust.append((f"c{i}", f"u{i}", "01001", "A", "SP"))
        for k, when in enumerate([f"2018-{(i % 9) + 1:02d}-01 00:00:00", None]):
            oid = f"o{i}_{k}"
            stamp = ts(when) if when else None
            if stamp is None:
                from datetime import date, timedelta
                stamp = ts((date(2018, 11, 12) - timedelta(days=d)).isoformat() + " 08:00:00")
            orders.append((oid, f"c{i}", "delivered", stamp))
            pays.append((oid, 1, "x", money(10 * (i + 1))))
    return make_tables(spark, cust, orders, pays)


def test_recency_edges_lower_bin(spark):
    t = _rfm_tables(spark, [25, 50, 75, 100])
    v = master.customer_delivered_orders(t.customers, t.orders, t.payments, t.as_of)
    base = rfm.rfm_base(v)
    bins = {r.recency_bucket: r.cnt for r in rfm.recency_bins(base).collect()}
    assert bins == {"Q1": 1, "Q2": 1, "Q3": 1, "Q4": 1}
    seg = {r.last_diff_days: r.r_segment for r in rfm.rfm_scored(base).collect()}
    assert seg == {25: "ACTIVE", 50: "WARM", 75: "WATCHING", 100: "OUTED"}


def test_ntile_remainder_and_even_median(spark):
    t = _rfm_tables(spark, [1, 2, 3, 4, 5])
    base = rfm.rfm_base(master.customer_delivered_orders(t.customers, t.orders, t.payments, t.as_of))
    sizes = sorted((r.m_bucket, r.cnt) for r in rfm.ntile_summary(base).collect())
    assert sizes == [(1, 2), (2, 1), (3, 1), (4, 1)]
    t4 = _rfm_tables(spark, [1, 2, 3, 4])
    base4 = rfm.rfm_base(master.customer_delivered_orders(t4.customers, t4.orders, t4.payments, t4.as_of))
    r = rfm.mean_median(base4).collect()[0]
    # sales per person: 2 orders x 10*(i+1) -> 20, 40, 60, 80
    assert r.sales_avg == 50.0 and r.sales_median == 50.0


def test_zero_denominators_give_null(spark):
    t = make_tables(spark, customers=[("c1", "u1", "01001", "A", "SP")],
                    orders=[("o1", "c1", "canceled", ts("2018-01-01 00:00:00"))])
    m = master.customer_master(t.customers, t.orders, t.payments)
    r = funnel.funnel_rates(m).collect()[0]
    assert r.delivered_customer_rate == 0.0 and r.repeat_rate is None and r.interest_to_repeat_rate is None
    v = spark.createDataFrame([], "customer_unique_id string, order_freq bigint")
    cats = spark.createDataFrame([("u1", "A")], "customer_unique_id string, category_group string")
    star = spark.createDataFrame([("u1",)], "customer_unique_id string")
    assert cohort.cohort_lift(cats, star, v).count() == 0
    # one-time customers exist but none in category A: lift is NULL, no error
    v2 = spark.createDataFrame([("u1", 3), ("u2", 1)], "customer_unique_id string, order_freq bigint")
    cats2 = spark.createDataFrame([("u1", "A"), ("u2", "B")], "customer_unique_id string, category_group string")
    rows = {r.category_group: r for r in cohort.cohort_lift(cats2, star, v2).collect()}
    assert rows["A"].star_cnt == 1 and rows["A"].one_time_cnt == 0 and rows["A"].lift is None
    assert rows["A"].star_pct == 100.0 and rows["B"].one_time_pct == 100.0 and rows["B"].lift == 0.0


def test_sequence_gaps_and_unpaid(spark):
    t = make_tables(spark, customers=[("c1", "u1", "01001", "A", "SP")],
                    orders=[("o1", "c1", "delivered", ts("2018-01-01 23:00:00")),
                            ("o2", "c1", "delivered", ts("2018-01-03 01:00:00")),
                            ("o3", "c1", "shipped", ts("2018-01-10 00:00:00"))],
                    payments=[("o1", 1, "x", money(10)), ("o2", 1, "x", money(15))])
    m = master.customer_master(t.customers, t.orders, t.payments)
    seq = {r.order_id: r for r in sequence.order_sequence(m, t.customers, t.orders, t.payments).collect()}
    assert [seq[o].order_times for o in ("o1", "o2", "o3")] == [1, 2, 3]
    assert seq["o1"].days_from_prev_order is None
    assert seq["o2"].days_from_prev_order == 2           # date parts only
    assert float(seq["o2"].diff_order_sales) == 5.0
    assert seq["o3"].order_sales is None and seq["o3"].diff_order_sales is None


def test_csv_edge_cases(spark, tmp_path):
    text = ('order_id,customer_id,status,purchase_timestamp,approval_timestamp,'
            'delivered_carrier_date,delivered_customer_date,estimated_delivery_date\r\n'
            '"o,1","c ""quoted""",delivered,2018-01-01 10:00:00,,,,2018-01-05 00:00:00\r\n'
            '"o2","multi\nline",canceled,,,,,\r\n')
    p = os.path.join(str(tmp_path), "orders.csv")
    with open(p, "w", newline="") as f:
        f.write(text)
    rows = sorted(load_csv(spark, p, "orders").collect(), key=lambda r: r.order_id)
    assert rows[0].order_id == "o,1" and rows[0].customer_id == 'c "quoted"'
    assert rows[0].purchase_timestamp == ts("2018-01-01 10:00:00") and rows[0].approval_timestamp is None
    assert rows[1].customer_id == "multi\nline" and rows[1].purchase_timestamp is None
    cp = os.path.join(str(tmp_path), "customers.csv")
    with open(cp, "w", newline="") as f:
        f.write("customer_id,customer_unique_id,zip_code_prefix,city,state\n"
                "c1,u1,01001,\"D'Oeste\",SP\n")
    c = load_csv(spark, cp, "customers").collect()[0]
    assert c.zip_code_prefix == "01001" and c.city == "D'Oeste"
    sp = os.path.join(str(tmp_path), "sellers.csv")
    with open(sp, "w", newline="") as f:
        f.write("seller_id,zip_code_prefix,city,state\ns1,1001,x,SP\n")
    assert load_csv(spark, sp, "sellers").collect()[0].zip_code_prefix == "01001"


def test_integrity_report_counts_violations(spark):
    from shoplens.operators import quality
    from shoplens.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS
    t = make_tables(spark,
                    customers=[("c1", "u1", "01001", "A", "SP"), ("c1", "u1", "01001", "A", "SP")],
                    orders=[("o1", "c1", "delivered", ts("2018-01-01 00:00:00")),
                            ("o2", "c_missing", "delivered", ts("2018-01-02 00:00:00"))],
                    payments=[("o1", 1, "x", money(1)), ("o9", 1, "x", money(1))],
                    items=[("o1", 1, "p_toy", money(1)), ("o1", 2, "p_unknown", money(1))],
                    products=PRODUCTS, dictionary=DICT)
    tables = {"customers": t.customers, "orders": t.orders, "order_payments": t.payments,
              "order_items": t.items, "products": t.products, "category_names_english": t.dictionary}
    got = {(r.kind, r.table_name, r.column_name): r.violations
           for r in quality.integrity_report(tables, FOREIGN_KEYS, PRIMARY_KEYS).collect()}
    assert got[("pk", "customers", "customer_id")] == 1
    assert got[("fk", "orders", "customer_id")] == 1
    assert got[("fk", "order_payments", "order_id")] == 1
    assert got[("fk", "order_items", "product_id")] == 1
    assert got[("fk", "products", "product_category")] == 1      # p_x -> nao_existe
    assert got[("pk", "orders", "order_id")] == 0


def test_accent_insensitive_city_option(spark):
    df = spark.createDataFrame([("São Paulo",), ("sao paulo",), ("SAO PAULO ",), ("Rio",)], "c string")
    binary = df.select(clean_city("c").alias("k")).distinct().count()
    folded = df.select(clean_city("c", "UNICODE_CI_AI").alias("k")).distinct().count()
    assert (binary, folded) == (3, 2)
