"""Resetting, rewriting and checking a stored catalogue; each makes a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, text
from .categories import STALE_ROOTS

#: Slug prefixes of imported categories. Fixed values.
IMPORTED_PREFIXES = ("et-", "inh-", "vs-")


def is_imported_category(slug: Column) -> Column:
    found = slug.isin(*STALE_ROOTS)
    for p in IMPORTED_PREFIXES:
        found = found | slug.startswith(p)
    return found


def reset_products(products: DataFrame, everything: bool = False) -> DataFrame:
    """Products without the imported ones (or without any), and without merge pointers."""
    kept = products.where(F.lit(False) if everything else F.col("external_source").isNull())
    return kept.withColumn("merged_into_product_id", F.lit(None).cast(dict(products.dtypes)["merged_into_product_id"]))


def reset_categories(categories: DataFrame) -> DataFrame:
    return categories.where(~is_imported_category(F.col("slug")))


def backfilled_keys(products: DataFrame) -> DataFrame:
    """Missing or blank name keys are computed; whether a row was filled is told."""
    blank = F.coalesce(F.col("name_norm_key"), F.lit("")) == ""
    return products.withColumn("backfilled", blank).withColumn("name_norm_key", F.when(blank, F.nullif(text.name_key(F.col("name_uk")), F.lit(""))).otherwise(F.col("name_norm_key")))


def pointed(products: DataFrame, pointers: DataFrame) -> DataFrame:
    """Products with new merge pointers; pointers that are set already stay."""
    p = pointers.select(F.col("loser").alias("__loser"), F.col("canonical").alias("__canonical"))
    joined = products.join(p, products["id"] == p["__loser"], "left")
    return joined.select(*[F.coalesce(products[c], p["__canonical"]).alias(c) if c == "merged_into_product_id" else products[c] for c in products.columns])


def mirrored(images: DataFrame, files: DataFrame) -> DataFrame:
    """Image rows whose URL was mirrored point to the file, the old URL becomes the source: ``files`` (url, name)."""
    f = files.select(F.col("url").alias("of_url"), F.concat(F.lit(media.PREFIX), "name").alias("local"))
    joined = images.join(f, images["url"] == F.col("of_url"), "left")
    source = F.when(F.col("local").isNotNull(), F.coalesce("source_url", "url")).otherwise(F.col("source_url"))
    url = F.coalesce("local", "url")
    return joined.select(*[c for c in images.columns if c not in ("url", "source_url")], source.alias("source_url"), url.alias("url"))


def media_status(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Each image row with its class: external, unsafe, stored, no_source, bad_hash or repairable.
    ``stored`` (name) lists the files that exist."""
    name = media.local_name(F.col("url"))
    named = images.withColumn("name", name)
    there = stored.select("name", F.lit(True).alias("there")).distinct()
    source = text.js_trim(F.coalesce(F.col("source_url"), F.lit("")))
    status = (
        F.when(~F.col("url").startswith(media.PREFIX), "external").when(F.col("name").isNull(), "unsafe").when(F.col("there"), "stored")
        .when(~source.rlike("^https?://"), "no_source").when(media.url_hash(source) != F.substring("name", 1, 64), "bad_hash").otherwise("repairable")
    )
    return named.join(there, "name", "left").withColumn("status", status).drop("there")


def missing_files(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Names that image rows need and that are not stored."""
    needed = images.select(media.local_name(F.col("url")).alias("name")).where("name IS NOT NULL").distinct()
    return needed.join(stored.select("name"), "name", "left_anti")
