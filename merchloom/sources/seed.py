"""The rows that an empty catalogue starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .tables import conform

# The demonstration catalogue, keyed by slug.
CATEGORIES = (
    ("tepla-pidloga", "Тепла підлога", "Тёплый пол", "Електричні системи обігріву підлоги: мати, кабель, плівка.", None, 0),
    ("nagrivalni-maty", "Нагрівальні мати", "Нагревательные маты", None, "tepla-pidloga", 10),
    ("griuchi-kabeli", "Гріючі кабелі", "Греющие кабели", None, "tepla-pidloga", 20),
)
BRANDS = (("demo-heat", "ElectroHeat Demo"),)
DEFINITIONS = (
    ("area_m2", "Площа обігріву", "м²", "dimensions", True, 10),
    ("power_w_m2", "Потужність", "Вт/м²", "electrical", True, 20),
    ("voltage_v", "Напруга", "В", "electrical", True, 30),
)
PRODUCTS = (
    ("demo-mat-2-0", "EH-DEMO-200", "Нагрівальний мат ElectroHeat 2,0 м²", "Двожильний мат для укладання під плитку в клей.", "8990", True, 10, "Нагрівальний мат 2 м² — каталог ElectroHeat"),
    ("demo-mat-3-5", "EH-DEMO-350", "Нагрівальний мат ElectroHeat 3,5 м²", "Збільшена площа — для ванної чи коридору.", None, False, 20, None),
)
SPECS = (("demo-mat-2-0", "area_m2", "2"), ("demo-mat-2-0", "power_w_m2", "150"), ("demo-mat-2-0", "voltage_v", "230"), ("demo-mat-3-5", "area_m2", "3.5"), ("demo-mat-3-5", "power_w_m2", "150"), ("demo-mat-3-5", "voltage_v", "230"))
#: What a second seeding changes in rows that exist; the rest stays. Fixed values.
POLICIES = {"categories": {"parent_id": "keep_if_null"}, "brands": {}, "spec_definitions": {"filterable": "overwrite"}, "products": {"published": "overwrite", "category_id": "overwrite", "name_norm_key": "overwrite"}}


def row_id(table: str, *keys) -> F.Column:
    """The id of a new row: a hash of its table and key, the same in each run."""
    return F.sha2(F.concat_ws("|", F.lit(table), *keys), 256)


def seed_rows(spark: SparkSession) -> dict[str, DataFrame]:
    """The seed as tables of the catalogue."""
    make = spark.createDataFrame
    category = row_id("categories", F.lit("nagrivalni-maty"))
    categories = make(CATEGORIES, "slug string, name_uk string, name_ru string, description string, parent string, sort_order int")
    categories = categories.withColumn("id", row_id("categories", "slug")).withColumn("parent_id", F.when(F.col("parent").isNotNull(), row_id("categories", "parent")))
    products = make(PRODUCTS, "slug string, sku string, name_uk string, short_description string, price_uah string, price_visible boolean, sort_order int, seo_title string")
    products = products.select("*", row_id("products", "slug").alias("id"), category.alias("category_id"), row_id("brands", F.lit(BRANDS[0][0])).alias("brand_id"), F.lit(True).alias("published"), text.name_key(F.col("name_uk")).alias("name_norm_key"))
    definitions = make(DEFINITIONS, "slug string, label_uk string, unit string, group_slug string, filterable boolean, sort_order int").withColumn("id", row_id("spec_definitions", "slug"))
    specs = make(SPECS, "product string, definition string, value_number string")
    specs = specs.select(row_id("product_specs", "product", "definition").alias("id"), row_id("products", "product").alias("product_id"), row_id("spec_definitions", "definition").alias("definition_id"), "value_number")
    found = {"categories": categories, "brands": make(BRANDS, "slug string, name string").withColumn("id", row_id("brands", "slug")), "products": products, "spec_definitions": definitions, "product_specs": specs}
    return {name: conform(df, name) for name, df in found.items()}
