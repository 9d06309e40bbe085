"""The driver's tables as the nine raw CSV exports, and a profile of tables
that shows whether an export came back as it was."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.sources import schemas
from shoplens.sources.files import load_csv, write_table
from shoplens.sources.star_schema import _read


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine raw tables, in the columns and types of their schemas. Texts of
    ``documents`` serve as review contents: they hold quotes, commas and line
    breaks. What the driver's tables lack is NULL."""
    nation = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    zip_code = F.lpad(F.col("n_nationkey").cast("string"), 5, "0")
    cols: dict[str, tuple[DataFrame, dict[str, Column]]] = {
        "geolocation": (nation, {"zip_code_prefix": zip_code, "latitude": F.col("n_nationkey") / 7, "longitude": -F.col("n_nationkey") / 3,
                                 "city": F.col("city"), "state": F.col("state")}),
        "customers": (_read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")),
                      {"customer_id": F.col("c_custkey"), "customer_unique_id": F.col("c_custkey"), "zip_code_prefix": zip_code,
                       "city": F.concat(F.col("city"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')), "state": F.col("state")}),
        "sellers": (_read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")),
                    {"seller_id": F.col("s_suppkey"), "zip_code_prefix": zip_code, "city": F.col("city"), "state": F.col("state")}),
        "orders": (_read(spark, sf_dir, "orders"),
                   {"order_id": F.col("o_orderkey"), "customer_id": F.col("o_custkey"), "status": F.col("o_orderstatus"),
                    "purchase_timestamp": F.col("o_orderdate")}),
        "order_reviews": (_read(spark, sf_dir, "documents"),
                          {"review_id": F.col("doc_id"), "order_id": F.col("doc_id"), "rating": F.col("doc_id") % 5 + 1,
                           "review_title": F.col("lang"), "review_content": F.col("text")}),
        "order_payments": (_read(spark, sf_dir, "lineitem"),
                           {"order_id": F.col("l_orderkey"), "payment_sequential": F.col("l_linenumber"),
                            "payment_type": F.col("l_returnflag"), "payment_value": F.col("l_extendedprice")}),
        "category_names_english": (_read(spark, sf_dir, "part").select("p_brand").distinct(),
                                   {"product_category": F.col("p_brand"), "product_category_eng": F.lower("p_brand")}),
        "products": (_read(spark, sf_dir, "part"),
                     {"product_id": F.col("p_partkey"), "product_category": F.col("p_brand"), "weight_g": F.col("p_size")}),
        "order_items": (_read(spark, sf_dir, "lineitem"),
                        {"order_id": F.col("l_orderkey"), "item_id": F.col("l_linenumber"), "product_id": F.col("l_partkey"),
                         "seller_id": F.col("l_suppkey"), "shipping_limit_date": F.col("l_shipdate"), "price": F.col("l_extendedprice")}),
    }
    return {t: df.select(*[c.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[t].fields])
            for t, (df, c) in cols.items()}


def round_trip(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Every table written to ``folder`` as CSV with a header and loaded again."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(folder, name)
        write_table(df, path, fmt="csv")
        out[name] = load_csv(df.sparkSession, path, name)
    return out


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: rows, values, and the sum of a checksum of each
    value's text, which does not depend on the order of rows. One aggregate a
    table; its single row is turned into one row a column."""
    parts = []
    for name, df in tables.items():
        def checksum(c: str) -> Column:
            return F.sum(F.conv(F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"))
        one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"n_{c}") for c in df.columns],
                     *[F.coalesce(checksum(c), F.lit(0).cast("bigint")).alias(f"s_{c}") for c in df.columns])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("row_cnt"), F.col(f"n_{c}").alias("value_cnt"),
                                  F.col(f"s_{c}").alias("checksum")) for c in df.columns])
        parts.append(one.select(F.lit(name).alias("table_name"), F.explode(rows).alias("r")).select("table_name", "r.*"))
    return reduce(DataFrame.unionByName, parts)
