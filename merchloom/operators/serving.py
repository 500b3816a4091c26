"""The catalogue's read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 40


def with_count(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str, predicate: Column | None = None) -> DataFrame:
    """``parents`` with the number of their children (that meet a predicate); the children are counted first."""
    counted = (children if predicate is None else children.where(predicate)).groupBy(foreign).agg(F.count("*").alias(name))
    joined = parents.join(counted, parents[key] == counted[foreign], "left")
    return joined.select(*[parents[c] for c in parents.columns], F.coalesce(counted[name], F.lit(0)).alias(name))


def first_child(children: DataFrame, parent: str, order: list[str], columns: list[str]) -> DataFrame:
    """The first child of each parent: a grouped minimum, so no group is sorted."""
    rest = [c for c in columns if c != parent]
    return children.groupBy(parent).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(parent, *[f"r.{c}" for c in rest])


def ordered_children(children: DataFrame, parent: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """The children of each parent as an array in order. A parent's children are one card's, so few."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return children.groupBy(parent).agg(rows.alias(name))


def visible(products: DataFrame) -> Column:
    return products["published"] & products["merged_into_product_id"].isNull()


def root_sections(categories: DataFrame, products: DataFrame) -> DataFrame:
    """Top categories with the counts of all their products and children."""
    roots = categories.where("parent_id IS NULL")
    counted = with_count(roots, products, "id", "category_id", "n_products")
    kids = categories.select(F.col("id").alias("kid"), F.col("parent_id").alias("of"))
    return with_count(counted, kids, "id", "of", "n_children").orderBy("sort_order", "name_uk")


def category_page(categories: DataFrame, products: DataFrame, images: DataFrame, brands: DataFrame, slug: str) -> tuple[DataFrame, DataFrame]:
    """(child categories with counts of visible products, visible products with brand and cover)."""
    own = categories.where(F.col("slug") == slug).select(F.col("id").alias("own_id"))
    shown = products.where(visible(products))
    children = categories.join(F.broadcast(own), categories["parent_id"] == F.col("own_id")).drop("own_id")
    children = with_count(children, shown, "id", "category_id", "n_products").orderBy("sort_order", "name_uk")
    own_shown = shown.join(F.broadcast(own), shown["category_id"] == F.col("own_id"), "left_semi")
    return children, listing(own_shown, images, brands).orderBy("sort_order", "name_uk")


def listing(products: DataFrame, images: DataFrame, brands: DataFrame) -> DataFrame:
    """``products`` with the names of their brands and their first images."""
    cover = first_child(images, "product_id", ["sort_order", "id", "url"], ["product_id", "url"]).withColumnRenamed("url", "cover")
    named = products.join(brands.select(F.col("id").alias("of_brand"), F.col("name").alias("brand")), products["brand_id"] == F.col("of_brand"), "left")
    return named.join(cover, named["id"] == cover["product_id"], "left").drop("of_brand", "product_id")


def redirects(products: DataFrame) -> DataFrame:
    """(id, slug, name_uk, redirect_slug, title): a product merged into a published one leads to it, one hop, and
    shows its title; titles fall back to names."""
    t = products.select(F.col("id").alias("t_id"), F.col("slug").alias("t_slug"), F.col("published").alias("t_published"), F.col("seo_title").alias("t_seo"), F.col("name_uk").alias("t_name"))
    p = products.join(t, products["merged_into_product_id"] == F.col("t_id"), "left")
    title = F.when(F.col("t_published"), F.coalesce("t_seo", "t_name")).otherwise(F.coalesce("seo_title", "name_uk"))
    return p.select("id", "slug", "name_uk", F.when(F.col("t_published"), F.col("t_slug")).alias("redirect_slug"), title.alias("title"))


def cards(products: DataFrame, specs: DataFrame, definitions: DataFrame, images: DataFrame) -> DataFrame:
    """Product cards with images and specs, with the redirect of merged products."""
    d = definitions.select(F.col("id").alias("of_definition"), "label_uk", "unit", F.col("sort_order").alias("place"))
    rows = specs.join(d, specs["definition_id"] == F.col("of_definition"))
    spec_lists = ordered_children(rows, "product_id", ["place", "label_uk"], ["place", "label_uk", "unit", "value_text", "value_number"], "specs")
    image_lists = ordered_children(images, "product_id", ["sort_order"], ["sort_order", "url", "alt_uk"], "images")
    p = redirects(products)
    return p.join(image_lists, p["id"] == image_lists["product_id"], "left").drop("product_id").join(spec_lists, F.col("id") == spec_lists["product_id"], "left").drop("product_id")


def category_options(categories: DataFrame) -> DataFrame:
    """(id, label), in order: all sections for a product's editor, by parent and name; labels name the parent."""
    p = categories.select(F.col("id").alias("p_id"), F.col("name_uk").alias("p_name"))
    labelled = categories.join(p, categories["parent_id"] == F.col("p_id"), "left")
    return labelled.orderBy(F.col("parent_id").asc_nulls_last(), "name_uk", "id").select("id", F.concat_ws(" → ", "p_name", "name_uk").alias("label"))


def brand_options(brands: DataFrame) -> DataFrame:
    """(id, name), in order of the names."""
    return brands.select("id", "name").orderBy("name", "id")


def sections_under(categories: DataFrame, root_slug: str) -> DataFrame:
    """(slug, href) of the sections directly below the section ``root_slug``: links are only shown to sections that are there and in their place."""
    root = categories.where(F.col("slug") == root_slug).select(F.col("id").alias("parent_id"))  # slugs are unique: one row at most
    return categories.join(F.broadcast(root), "parent_id", "left_semi").select("slug", F.concat(F.lit("/catalog/"), "slug").alias("href"))


def matches(query: str | None, columns: list[str]) -> Column:
    """Case-insensitive substring in any of the columns; no query matches everything."""
    if not query or not query.strip():
        return F.lit(True)
    pattern = "%" + query.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return found


def search(df: DataFrame, query: str | None, columns: list[str], order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of results: a limit by nature."""
    return df.where(matches(query, columns)).orderBy(*order).offset((page - 1) * size).limit(size)


def search_total(df: DataFrame, query: str | None, columns: list[str], size: int = PAGE_SIZE) -> DataFrame:
    total = df.where(matches(query, columns)).agg(F.count("*").alias("total"))
    return total.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def optional(left: DataFrame, right: DataFrame, on: Column, columns: dict[str, str]) -> DataFrame:
    """``left`` with columns of ``right`` where there is a match; ``right`` is unique on its key."""
    return left.join(right, on, "left").select(*[left[c] for c in left.columns], *[right[c].alias(n) for c, n in columns.items()])


def every(parents: DataFrame, children: DataFrame, on: tuple[str, str], predicate: Column) -> DataFrame:
    """Parents of which every child meets a predicate; parents without children are among them."""
    against = children.where(~F.coalesce(predicate, F.lit(False))).select(F.col(on[1]).alias(on[0]))
    return parents.join(against, on[0], "left_anti")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
