"""Adapter: the driver's TPC-H-like star schema seen as e-commerce tables.

| concept          | built from                                                     |
|------------------|----------------------------------------------------------------|
| customers        | customer x nation x region: customer_id = customer_unique_id = |
|                  | c_custkey, city = n_name, state = r_name,                      |
|                  | zip_code_prefix = lpad(c_nationkey, 5, '0')                    |
| orders           | o_orderkey, o_custkey, o_orderstatus, o_orderdate (+ priority) |
|                  | status 'F' plays "delivered"                                   |
| order_payments   | lineitem: payment_type = l_returnflag,                         |
|                  | payment_value = l_extendedprice as DECIMAL(12,2) (1:N/order)   |
| order_items      | lineitem: product_id = l_partkey, price as above               |
| products         | part: product_category = p_brand                               |
| category dict    | distinct p_brand of part with brand number 1..24;              |
|                  | English name 'Brand_<n>', cleaned to 'brand_<n>'; groups G1..G7|
|                  | for n = 1..21 (three brands each), 'Others' for 22..24.        |
|                  | Brand#25 is not in the dictionary: it is the "unknown          |
|                  | category" case.                                                |
| as_of            | 2001-08-01 (last order day of the data)                        |

Every frame is a lazy projection of a parquet scan, so Catalyst prunes
columns and pushes filters into the scans.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.categories import map_category
from shoplens.functions.text import clean_city

DELIVERED = "F"
AS_OF = "2001-08-01"
DICT_BRANDS = 24          # brands 1..24 are in the dictionary
BRANDS_PER_GROUP = 3      # G1 = brands 1-3, ..., G7 = brands 19-21
GROUPED_BRANDS = 21       # brands 22..24 map to 'Others'


def brand_mapping() -> dict[str, str]:
    """Rule-built mapping for the adapter's dictionary (24 entries)."""
    out = {}
    for n in range(1, DICT_BRANDS + 1):
        group = f"G{(n - 1) // BRANDS_PER_GROUP + 1}" if n <= GROUPED_BRANDS else "Others"
        out[f"brand_{n}"] = group
    return out


@dataclass
class Tables:
    """The e-commerce tables an analysis needs, plus run parameters."""

    customers: DataFrame
    orders: DataFrame
    payments: DataFrame
    items: DataFrame
    products: DataFrame
    dictionary: DataFrame            # product_category, product_category_eng, clean_category, category_group
    delivered: str = "delivered"
    as_of: str = "2018-11-12"
    extra: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def customers_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    nation = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(_read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (c.join(nation, c.c_nationkey == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .select(F.col("c_custkey").alias("customer_id"),
                    # every fourth person has a second customer id, as a rule with another address
                    (F.col("c_custkey") - (F.col("c_custkey") % 4 == 1).cast("int")).alias("customer_unique_id"),
                    F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip_code_prefix"),
                    # every fifth row spells its city another way
                    F.when(F.col("c_custkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("city"),
                    F.col("r_name").alias("state"))
            .withColumn("clean_city", clean_city("city")))


def dictionary_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dictionary derived from the distinct brands of ``part``.

    The filter keeps brand numbers 1..24 only, so the result has at most 24
    rows whatever the size of ``part``; it is safe to broadcast.
    """
    brand_no = F.regexp_extract(F.col("p_brand"), r"^Brand#(\d+)$", 1)
    raw = (_read(spark, sf_dir, "part").select("p_brand").distinct()
           .where((brand_no != "") & brand_no.cast("int").between(1, DICT_BRANDS))
           .select(F.col("p_brand").alias("product_category"),
                   F.concat(F.lit("Brand_"), brand_no).alias("product_category_eng")))
    return map_category(raw, brand_mapping())


def from_star_schema(spark: SparkSession, sf_dir: str) -> Tables:
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("purchase_timestamp"),
        F.col("o_orderpriority").alias("priority"))
    line = _read(spark, sf_dir, "lineitem")
    payments = line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("payment_value"))
    items = line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    products = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("product_category"))
    return Tables(
        customers=customers_from_star(spark, sf_dir),
        orders=orders,
        payments=payments,
        items=items,
        products=products,
        dictionary=dictionary_from_star(spark, sf_dir),
        delivered=DELIVERED,
        as_of=AS_OF,
    )
