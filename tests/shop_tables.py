"""Hand-made tables for the tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from shoplens.functions.categories import map_category
from shoplens.functions.text import clean_city
from shoplens.sources import schemas
from shoplens.sources.star_schema import Tables


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def make_tables(spark, customers, orders, payments=(), items=(), products=(), dictionary=(),
                as_of="2018-11-12"):
    """Build :class:`Tables` from plain tuples in the raw column order.

    customers: (customer_id, customer_unique_id, zip, city, state)
    orders: (order_id, customer_id, status, purchase_timestamp)
    payments: (order_id, seq, type, value)
    items: (order_id, item_id, product_id, price)
    products: (product_id, product_category)
    dictionary: (product_category, product_category_eng)
    """
    c = spark.createDataFrame(list(customers), schemas.CUSTOMERS).withColumn("clean_city", clean_city("city"))
    o_schema = "order_id string, customer_id string, status string, purchase_timestamp timestamp_ntz"
    o = spark.createDataFrame(list(orders), o_schema)
    p = spark.createDataFrame(list(payments), "order_id string, payment_sequential int, "
                                              "payment_type string, payment_value decimal(10,2)")
    i = spark.createDataFrame(list(items), "order_id string, item_id int, product_id string, "
                                           "price decimal(10,2)")
    d = spark.createDataFrame(list(products), "product_id string, product_category string")
    k = map_category(spark.createDataFrame(list(dictionary), schemas.CATEGORY_NAMES))
    return Tables(customers=c, orders=o, payments=p, items=i, products=d, dictionary=k,
                  delivered="delivered", as_of=as_of)
