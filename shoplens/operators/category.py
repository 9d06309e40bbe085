"""Item x category view and category reports (sales, orders, ranks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.common import money, rounded_ratio
from shoplens.functions.joins import gathered, spread_join

UNKNOWN = "Unknown"


def product_categories(products: DataFrame, dictionary: DataFrame, unknown: str = "drop",
                       ) -> DataFrame:
    """``product_id -> product_category, product_category_eng, clean_category, category_group``.

    ``unknown='drop'``: products whose category is not in the dictionary are
    dropped (inner join); ``'keep'``: kept with group ``'Unknown'``.
    Whether the dictionary is broadcast is left to its size.
    """
    d = dictionary.select("product_category", "product_category_eng", "clean_category", "category_group")
    p = products.select("product_id", "product_category")
    if unknown == "drop":
        return p.join(d, "product_category")
    if unknown == "keep":
        return (p.join(d, "product_category", "left")
                .withColumn("category_group", F.coalesce(F.col("category_group"), F.lit(UNKNOWN))))
    raise ValueError("unknown must be 'drop' or 'keep'")


def item_categories(items: DataFrame, products: DataFrame, dictionary: DataFrame,
                    unknown: str = "drop") -> DataFrame:
    """Item rows with their category (one row per item row; an order can
    have several). Items of one product are spread over several tasks."""
    pc = product_categories(products, dictionary, unknown)
    return spread_join(items.select("order_id", "product_id", "price"), pc, "product_id", F.col("order_id"))


def order_product(items: DataFrame, products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The item x category view: order_id, product_id, clean_category, category_group, price."""
    return item_categories(items, products, dictionary).select(
        "order_id", "product_id", "clean_category", "category_group", "price")


def order_group_summary(items: DataFrame, products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per (order, category group): item rows and their price sum, plus
    ``_known`` (False for the 'Unknown' rows of products outside the
    dictionary). Far smaller than the item table (one row per order and
    group); every category report below aggregates this instead of the items.
    """
    d = dictionary.select("product_category", "category_group").withColumn("_known", F.lit(True))
    pc = products.select("product_id", "product_category").join(d, "product_category", "left")
    keys = ["order_id", "category_group", "_known"]

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("_items").alias("_items"), F.sum("_sales").alias("_sales"))
    rows = spread_join(items.select("order_id", "product_id", "price"), pc, "product_id", F.col("order_id")).select(
        "order_id", F.coalesce(F.col("category_group"), F.lit(UNKNOWN)).alias("category_group"),
        F.coalesce(F.col("_known"), F.lit(False)).alias("_known"),
        F.lit(1).cast("bigint").alias("_items"), F.col("price").alias("_sales"))
    kind = total(rows).schema["_sales"].dataType
    return total(gathered(rows, "order_id", total, items)).withColumn("_sales", F.col("_sales").cast(kind))


def _as_summary(df: DataFrame) -> DataFrame:
    """Accept the item x category view or an ``order_group_summary``."""
    if "_items" in df.columns:
        return df.where(F.col("_known")) if "_known" in df.columns else df
    return (df.groupBy("order_id", "category_group")
            .agg(F.count(F.lit(1)).alias("_items"), F.sum("price").alias("_sales")))


def category_orders(op: DataFrame) -> DataFrame:
    """Distinct orders per category group (an order counts once per group)."""
    return _as_summary(op).groupBy("category_group").agg(F.count(F.lit(1)).alias("order_cnt"))


def _summary(op: DataFrame) -> DataFrame:
    return _as_summary(op).groupBy("category_group").agg(
        F.count(F.lit(1)).alias("order_cnt"),
        F.sum("_items").cast("bigint").alias("item_cnt"),
        F.sum("_sales").alias("_sales"))


def category_rank(op: DataFrame, measure: str = "order_cnt") -> DataFrame:
    """Dense rank of category groups by order count or by sales (descending).
    The grouped input has one row per group, so the rank window is tiny."""
    s = _summary(op)
    if measure == "order_cnt":
        return s.select("category_group", "order_cnt",
                        F.dense_rank().over(Window.orderBy(F.desc("order_cnt"))).cast("bigint")
                        .alias("order_cnt_rnk"))
    if measure == "sales":
        return s.select("category_group", money("_sales").alias("sales"),
                        F.dense_rank().over(Window.orderBy(F.desc("_sales"))).cast("bigint")
                        .alias("sales_rnk"))
    raise ValueError("measure must be 'order_cnt' or 'sales'")


def category_order_value(op: DataFrame) -> DataFrame:
    """Sales per distinct order, with RANK by that value, by orders and by sales."""
    s = _summary(op)
    s = s.select("category_group", "order_cnt", "_sales", money("_sales").alias("sales"),
                 rounded_ratio(F.col("_sales"), F.col("order_cnt"), 2)
                 .alias("avg_sales_per_order"))
    return s.select(
        "*",
        F.rank().over(Window.orderBy(F.desc("avg_sales_per_order"))).cast("bigint").alias("avg_order_value_rnk"),
        F.rank().over(Window.orderBy(F.desc("order_cnt"))).cast("bigint").alias("order_cnt_rnk"),
        F.rank().over(Window.orderBy(F.desc("_sales"))).cast("bigint").alias("sales_rnk")).drop("_sales")


def category_item_price(op: DataFrame) -> DataFrame:
    """Average price per item row, with RANK by it, by orders and by sales."""
    s = _summary(op)
    s = s.select("category_group", "order_cnt", "item_cnt", "_sales", money("_sales").alias("sales"),
                 rounded_ratio(F.col("_sales"), F.col("item_cnt"), 2)
                 .alias("avg_price_per_item_row"))
    return s.select(
        "*",
        F.rank().over(Window.orderBy(F.desc("avg_price_per_item_row"))).cast("bigint").alias("item_price_rnk"),
        F.rank().over(Window.orderBy(F.desc("order_cnt"))).cast("bigint").alias("order_cnt_rnk"),
        F.rank().over(Window.orderBy(F.desc("_sales"))).cast("bigint").alias("sales_rnk")).drop("_sales")


def order_category_counts(items: DataFrame, products: DataFrame, dictionary: DataFrame,
                          unknown: str = "drop", summary: DataFrame | None = None) -> DataFrame:
    """Item rows per (order, category group), reduced before any join to orders.
    Reuses a precomputed :func:`order_group_summary` when given."""
    if summary is None:
        summary = order_group_summary(items, products, dictionary)
    if unknown == "drop":
        summary = summary.where(F.col("_known"))
    elif unknown != "keep":
        raise ValueError("unknown must be 'drop' or 'keep'")
    return summary.select("order_id", "category_group", "_items")
