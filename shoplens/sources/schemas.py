"""Declared schemas of the nine raw e-commerce tables plus the exported cross-tab.

Column order follows the CSV files (positional load). Money is DECIMAL(10,2),
coordinates DECIMAL(10,7), datetimes carry no zone (TIMESTAMP_NTZ). Zip codes
are strings so leading zeros survive; the sellers zip is read as a string and
left-padded by ``load_csv``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
COORD = T.DecimalType(10, 7)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


GEOLOCATION = _schema(
    ("zip_code_prefix", S, False), ("latitude", COORD, True), ("longitude", COORD, True),
    ("city", S, True), ("state", S, True))

CUSTOMERS = _schema(
    ("customer_id", S, False), ("customer_unique_id", S, True),
    ("zip_code_prefix", S, False), ("city", S, True), ("state", S, True))

SELLERS = _schema(
    ("seller_id", S, False), ("zip_code_prefix", S, True), ("city", S, True), ("state", S, True))

ORDERS = _schema(
    ("order_id", S, False), ("customer_id", S, False), ("status", S, True),
    ("purchase_timestamp", TS, True), ("approval_timestamp", TS, True),
    ("delivered_carrier_date", TS, True), ("delivered_customer_date", TS, True),
    ("estimated_delivery_date", TS, True))

ORDER_REVIEWS = _schema(
    ("review_id", S, True), ("order_id", S, False), ("rating", I, True),
    ("review_title", S, True), ("review_content", S, True),
    ("creation_timestamp", TS, True), ("answer_timestamp", TS, True))

ORDER_PAYMENTS = _schema(
    ("order_id", S, False), ("payment_sequential", I, True), ("payment_type", S, True),
    ("payment_installments", I, True), ("payment_value", MONEY, True))

CATEGORY_NAMES = _schema(
    ("product_category", S, False), ("product_category_eng", S, True))

PRODUCTS = _schema(
    ("product_id", S, False), ("product_category", S, True), ("name_length", I, True),
    ("description_length", I, True), ("photos_quantity", I, True), ("weight_g", I, True),
    ("length_cm", I, True), ("height_cm", I, True), ("width_cm", I, True))

ORDER_ITEMS = _schema(
    ("order_id", S, False), ("item_id", I, True), ("product_id", S, False),
    ("seller_id", S, False), ("shipping_limit_date", TS, True),
    ("price", MONEY, True), ("freight_value", MONEY, True))

CROSS_TAB = _schema(
    ("category_group", S, True), ("star_cnt", L, True), ("one_time_cnt", L, True))

TABLES: dict[str, T.StructType] = {
    "geolocation": GEOLOCATION,
    "customers": CUSTOMERS,
    "sellers": SELLERS,
    "orders": ORDERS,
    "order_reviews": ORDER_REVIEWS,
    "order_payments": ORDER_PAYMENTS,
    "category_names_english": CATEGORY_NAMES,
    "products": PRODUCTS,
    "order_items": ORDER_ITEMS,
    "cross_tab": CROSS_TAB,
}

# Declared primary keys and foreign keys (used by the integrity report).
PRIMARY_KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "orders": ["order_id"],
    "category_names_english": ["product_category"],
    "products": ["product_id"],
}

FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    # (child table, child column, parent table, parent column)
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("products", "product_category", "category_names_english", "product_category"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
]
