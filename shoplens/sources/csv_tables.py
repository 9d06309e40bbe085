"""Tables from a folder of raw CSV exports (one file per table).

Loads the five tables the analyses read (customers, orders, order_payments,
order_items, products) plus the category dictionary with their declared
schemas, then applies the cleaning step: ``clean_city`` on customers,
``clean_category`` / ``category_group`` on the dictionary. The other raw
tables (geolocation, sellers, order_reviews) load with
:func:`shoplens.sources.files.load_csv` when needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.categories import map_category
from shoplens.functions.text import clean_city
from shoplens.sources.files import exists, import_table, load_csv, rejected_rows
from shoplens.sources.star_schema import Tables

DEFAULT_FILES = {
    "customers": "customers.csv",
    "orders": "orders.csv",
    "order_payments": "order_payments.csv",
    "order_items": "order_items.csv",
    "products": "products.csv",
    "category_names_english": "category_names_english.csv",
    # optional: only the integrity report reads them
    "sellers": "sellers.csv",
    "order_reviews": "order_reviews.csv",
    "geolocation": "geolocation.csv",
}
OPTIONAL = ("sellers", "order_reviews", "geolocation")


def from_csv_folder(spark: SparkSession, folder: str, files: dict[str, str] | None = None,
                    delivered: str = "delivered", as_of: str = "2018-11-12",
                    mapping: dict[str, str] | None = None, city_collation: str | None = None,
                    import_to: str | None = None, single_line: tuple[str, ...] = ()) -> Tables:
    """``city_collation='UNICODE_CI_AI'`` groups city names case- and
    accent-insensitively (see :func:`shoplens.functions.text.clean_text`).

    ``import_to``: a folder (shared storage) into which every table is loaded
    once as Parquet; records that do not fit their schema are then left out of
    the tables and listed in ``extra["reject_records"]`` (record, file and
    reason). Without it the files are parsed by every report and such records
    stay with NULL values. ``single_line``: tables known to hold no line break
    inside quotes, whose files can be split between tasks."""
    names = dict(DEFAULT_FILES)
    names.update(files or {})

    def place(table: str) -> str:
        return f"{folder.rstrip('/')}/{names[table]}"

    loaded = [t for t in names if t not in OPTIONAL or exists(spark, place(t))]
    lines = {t: t not in single_line for t in loaded}
    extra: dict = {}
    if import_to is None:
        tables = {t: load_csv(spark, place(t), t, lines[t]) for t in loaded}
        extra["rejects"] = {t: rejected_rows(spark, place(t), t, lines[t]) for t in loaded}
    else:
        parts = {t: import_table(spark, place(t), t, f"{import_to.rstrip('/')}/{t}", lines[t]) for t in loaded}
        tables = {t: good for t, (good, _) in parts.items()}
        extra["rejects"] = {t: bad.agg(F.count(F.lit(1)).alias("rejected")) for t, (_, bad) in parts.items()}
        extra["reject_records"] = reduce(DataFrame.unionByName, [bad for _, bad in parts.values()])
    extra["raw_tables"] = {t: tables[t] for t in OPTIONAL if t in tables}
    return Tables(
        customers=tables["customers"].withColumn("clean_city", clean_city("city", city_collation)),
        orders=tables["orders"],
        payments=tables["order_payments"],
        items=tables["order_items"],
        products=tables["products"],
        dictionary=map_category(tables["category_names_english"], mapping),
        delivered=delivered,
        as_of=as_of,
        extra=extra,
    )
