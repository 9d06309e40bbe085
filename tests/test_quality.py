"""Data-check operators (variant report, drift, uniqueness, cardinality)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.text import clean_city
from shoplens.operators import quality


def _customers(spark):
    rows = [("c1", "u1", "45816", "Sao Joao", "BA"), ("c2", "u1", "45816", "sao joao", "BA"),
            ("c3", "u2", "45816", "Sao Joao D'Alianca", "GO"), ("c4", "u3", "01001", "x", "SP"),
            ("c5", "u3", "01002", "x", "SP")]
    df = spark.createDataFrame(rows, "customer_id string, customer_unique_id string, "
                                     "zip_code_prefix string, city string, state string")
    return df.withColumn("clean_city", clean_city("city"))


def test_variant_report(spark):
    r = quality.variant_report(_customers(spark), "zip_code_prefix").collect()
    assert len(r) == 1
    x = r[0]
    assert (x.zip_code_prefix, x.raw_city_cnt, x.clean_city_cnt, x.state_cnt, x.row_cnt) == ("45816", 3, 2, 2, 3)


def test_distinct_values(spark):
    got = quality.distinct_values(_customers(spark), ["clean_city"], F.col("zip_code_prefix") == "45816")
    assert sorted(r[0] for r in got.collect()) == ["sao joao", "sao joao d alianca"]


def test_attribute_drift(spark):
    got = {r.customer_unique_id: (r.state_cnt, r.clean_city_cnt, r.zip_code_prefix_cnt)
           for r in quality.attribute_drift(_customers(spark), "customer_unique_id",
                                            ["state", "clean_city", "zip_code_prefix"]).collect()}
    assert got == {"u3": (1, 1, 2)}


def test_key_uniqueness_and_duplicates(spark):
    df = _customers(spark)
    r = quality.key_uniqueness(df, "customer_unique_id").collect()[0]
    assert (r.row_cnt, r.unique_key_cnt) == (5, 3)
    assert quality.key_uniqueness(df, "customer_unique_id", "unique_customer_cnt").columns == ["row_cnt", "unique_customer_cnt"]
    dups = {x.customer_unique_id: x.cnt for x in quality.duplicate_keys(df, ["customer_unique_id"]).collect()}
    assert dups == {"u1": 2, "u3": 2}


def test_orphans_ignore_null_references(spark):
    child = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in quality.orphans(child, parent, "k", "k").collect()] == ["b"]


def test_mapping_cardinality(spark):
    df = spark.createDataFrame([("toys", "S"), ("cool_stuff", "S"), ("baby", "B")], "clean_category string, category_group string")
    r = quality.mapping_cardinality(df, ["clean_category", "category_group"]).collect()[0]
    assert (r.clean_category_cnt, r.category_group_cnt) == (3, 2)


def test_attribute_drift_original_names(spark):
    got = quality.attribute_drift(_customers(spark), "customer_unique_id", ["state", "clean_city", "zip_code_prefix"],
                                  names={"clean_city": "city_cnt", "zip_code_prefix": "zip_cnt"})
    assert got.columns == ["customer_unique_id", "state_cnt", "city_cnt", "zip_cnt"]
    assert [tuple(r) for r in got.collect()] == [("u3", 1, 1, 2)]
