"""Category dictionary: cleaned category name -> category group.

The mapping is data (a small DataFrame joined by broadcast), not a CASE chain,
so a different catalogue is a different dictionary argument.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.text import clean_category

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's grouping of the 71 cleaned category
# names into 10 groups; misspellings are real keys of the source data and are
# kept as they are). Anything not listed, and NULL, falls into DEFAULT_GROUP.
# ---------------------------------------------------------------------------
DEFAULT_GROUP = "Others"

CATEGORY_GROUPS: dict[str, tuple[str, ...]] = {
    "Food & Beverage": (
        "food", "drinks", "food_drink",
    ),
    "Electronics & Digital": (
        "computers", "computers_accessories", "tablets_printing_image", "telephony",
        "fixed_telephony", "audio", "electronics", "home_appliances", "home_appliances_2",
        "small_appliances", "small_appliances_home_oven_and_coffee", "air_conditioning",
        "consoles_games", "cine_photo",
    ),
    "Fashion & Accessories": (
        "fashion_shoes", "fashion_bags_accessories", "fashion_male_clothing",
        "fashio_female_clothing", "fashion_underwear_beach", "fashion_sport",
        "fashion_childrens_clothes", "luggage_accessories", "watches_gifts",
    ),
    "Home & Living": (
        "furniture_bedroom", "furniture_living_room", "furniture_decor",
        "furniture_mattress_and_upholstery", "home_confort", "home_comfort_2",
        "home_construction", "housewares", "kitchen_dining_laundry_garden_furniture",
        "bed_bath_table", "garden_tools", "office_furniture", "la_cuisine",
    ),
    "Beauty & Health": (
        "health_beauty", "perfumery", "diapers_and_hygiene",
    ),
    "Sports & Leisure": (
        "sports_leisure", "toys", "cool_stuff",
    ),
    "Books & Media": (
        "books_general_interest", "books_technical", "books_imported", "cds_dvds_musicals",
        "dvds_blu_ray", "music", "musical_instruments", "art", "arts_and_craftmanship",
        "stationery",
    ),
    "Baby & Kids": (
        "baby",
    ),
    "Auto & Industrial": (
        "auto", "agro_industry_and_commerce", "industry_commerce_and_business",
        "construction_tools_construction", "construction_tools_lights",
        "construction_tools_safety", "costruction_tools_garden", "costruction_tools_tools",
        "signaling_and_security", "security_and_services",
    ),
    "Others": (
        "pet_shop", "flowers", "christmas_supplies", "party_supplies", "market_place",
    ),
}
# --------------------------------------------------------------------------- end


def default_mapping() -> dict[str, str]:
    return {name: group for group, names in CATEGORY_GROUPS.items() for name in names}


def mapping_frame(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """The mapping as a two-column DataFrame (clean_category, category_group)."""
    mapping = default_mapping() if mapping is None else mapping
    schema = T.StructType([T.StructField("clean_category", T.StringType(), False),
                           T.StructField("category_group", T.StringType(), False)])
    return spark.createDataFrame(sorted(mapping.items()), schema)


def map_category(dictionary: DataFrame, mapping: dict[str, str] | None = None,
                 default: str = DEFAULT_GROUP, source_col: str = "product_category_eng"
                 ) -> DataFrame:
    """Add ``clean_category`` and ``category_group`` to a category dictionary.

    ``dictionary`` has one row per raw category (a few dozen rows). The
    mapping frame has a fixed size (``len(mapping)`` rows) and is broadcast.
    Unknown names and NULL map to ``default``.
    """
    spark = dictionary.sparkSession
    groups = F.broadcast(mapping_frame(spark, mapping))
    cleaned = dictionary.withColumn("clean_category", clean_category(source_col))
    return (cleaned.join(groups, "clean_category", "left")
            .withColumn("category_group", F.coalesce(F.col("category_group"), F.lit(default)))
            .select(*dictionary.columns, "clean_category", "category_group"))
