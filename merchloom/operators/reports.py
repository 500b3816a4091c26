"""Duplicate and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("base_code_cross_source", "url_leaf_cross_source", "name_cross_source", "name_same_source")


def key_groups(rows: DataFrame, key: Column, source: str, least_length: int = 1) -> DataFrame:
    """Groups of at least two rows with the same key: count, sorted sources ('null' for none) and the
    number of named sources. Only counts and sources are gathered, never the rows."""
    keyed = rows.select(key.alias("key"), F.col(source).alias("source")).where(F.length("key") >= least_length)
    named = F.nullif(F.col("source"), F.lit(""))
    return (
        keyed.groupBy("key")
        .agg(F.count("*").alias("count"), F.array_sort(F.collect_set(F.coalesce("source", F.lit("null")))).alias("sources"), F.count_distinct(named).alias("n_named"), F.count(named).alias("n_with_source"))
        .where("count > 1")
    )


def cross_source(groups: DataFrame, kind: str) -> DataFrame:
    return groups.where("n_named >= 2").select(F.lit(kind).alias("kind"), F.substring("key", 1, 120).alias("key"), "count", "sources")


def same_source(groups: DataFrame, kind: str = KINDS[3]) -> DataFrame:
    return groups.where("n_named = 1 AND n_with_source = count").select(F.lit(kind).alias("kind"), F.substring("key", 1, 120).alias("key"), "count", "sources")


def group_items(rows: DataFrame, key: Column, groups: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the groups, one by one, beside their group's key."""
    return rows.withColumn("key", key).join(groups.select("key"), "key", "left_semi").select("key", *columns)


def ordered(groups: DataFrame) -> DataFrame:
    """By kind, then by size."""
    rank = F.lit(len(KINDS))
    for i, kind in enumerate(KINDS):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    return groups.orderBy(rank, F.col("count").desc(), "key")


def header(products: DataFrame, sources: list[str]) -> DataFrame:
    """One row: number of products, and of those whose code names its source."""
    composite = F.lit(False)
    for source in sources:
        composite = composite | F.coalesce(F.col("sku").contains(f"__{source}__"), F.lit(False))
    return products.agg(F.count("*").alias("total_products"), F.count_if(composite).alias("with_composite_sku"))


def summary(groups: DataFrame) -> DataFrame:
    """Number of groups of each kind, in one row."""
    return groups.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def duplicates(products: DataFrame, sources: list[str]) -> DataFrame:
    """The duplicate report of a catalogue: by base code, URL leaf and name across sources, and by
    name within a source."""
    from ..functions import text, urls

    by_code = key_groups(products, text.base_code(F.col("sku"), sources), "external_source", 2)
    by_leaf = key_groups(products, urls.leaf_key(F.col("external_url")), "external_source")
    by_name = key_groups(products, text.name_key(F.col("name_uk")), "external_source", 12)
    parts = [cross_source(g, k) for g, k in zip((by_code, by_leaf, by_name), KINDS)] + [same_source(by_name)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def health(products: DataFrame) -> DataFrame:
    """All counters of a catalogue in one pass, with the number of repeated stock codes."""
    has = lambda c: F.col(c).isNotNull()
    counts = products.agg(
        F.count("*").alias("total"),
        F.count_if("published").alias("published"),
        F.count_if(has("external_source") & has("external_id")).alias("with_external"),
        F.count_if(has("external_url")).alias("with_url"),
        F.count_if(has("source_category_url")).alias("with_category_url"),
    )
    return counts.join(repeated(products, "sku").agg(F.count("*").alias("duplicate_sku_groups")), F.lit(True))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def latest(df: DataFrame, predicate: Column, order: list[Column], n: int = 3) -> DataFrame:
    """The latest rows that meet a predicate: a top-n, so a limit by nature."""
    return df.where(predicate).orderBy(*order).limit(n)


def carried_forward(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that was not null up to each row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
