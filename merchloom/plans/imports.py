"""Importing manifests into a catalogue: one keyed merge for each table, whatever the number of rows.

A catalogue is a dict of tables (see ``sources.tables``). Every step gives a new one and changes
nothing in place; ``rebuild`` writes each as a snapshot that readers see only when it is complete.
Products that belong nowhere (an unknown source, a section URL of another shop, a section that was never seeded) are returned as
rejected, with the reason, instead of stopping the import.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import categories, consolidate, maintenance, similarity, trees, upsert
from ..sources import manifests, seed, tables

Catalogue = dict[str, DataFrame]
#: Writes a table that several later steps read, and reads it back; or leaves it as a plan.
Stage = Callable[[DataFrame, str], DataFrame]
#: Blocks of a manifest that hold crawled section titles; later blocks win. Fixed values.
TITLE_BLOCKS = ("etMarketCrawl", "inHeat", "vsesezon")
#: Why products are rejected.
NO_KEY, NO_SECTION, NOT_SEEDED = "no source or external id", "unknown source, or a URL of another shop", "its section is not in the catalogue"


def empty_catalogue(spark: SparkSession) -> Catalogue:
    return {name: tables.empty(spark, name) for name in tables.SCHEMAS}


def seeded(catalogue: Catalogue) -> Catalogue:
    """``catalogue`` with the seed rows merged in; seeding twice is seeding once."""
    spark, out = catalogue["products"].sparkSession, dict(catalogue)
    for name, rows in seed.seed_rows(spark).items():
        if name == "product_specs":
            out[name] = upsert.merge(out[name], rows, ["id"], {"value_number": "overwrite", "value_text": "overwrite"})
        else:
            out[name] = _merged_by_slug(out[name], rows, name, seed.POLICIES[name])
    return out


def _merged_by_slug(current: DataFrame, incoming: DataFrame, name: str, policy: dict[str, str]) -> DataFrame:
    """A merge by slug; ids of rows that exist stay, as create_only columns do."""
    return tables.conform(upsert.merge(current, incoming, ["slug"], policy), name)


def section_titles(found: DataFrame) -> DataFrame:
    """(url, title, position) of the crawled sections of some manifests."""
    parts = [
        found.select("file_ord", F.lit(i).alias("block"), F.posexplode(f"{block}.perCategory").alias("pos", "c")).select("file_ord", "block", "pos", F.col("c.categoryUrl").alias("url"), F.col("c.title").alias("title"))
        for i, block in enumerate(TITLE_BLOCKS)
    ]
    rows = reduce(DataFrame.union, parts).where("title IS NOT NULL AND title <> ''")
    return rows.select("url", "title", F.struct("file_ord", "block", "pos").alias("at")).select("url", "title", (F.col("at.file_ord").cast("long") * 2**40 + F.col("at.block").cast("long") * 2**36 + F.col("at.pos")).alias("position"))


def reduced(rows: DataFrame, keys: list[str], order: Column, policy: dict[str, str]) -> DataFrame:
    """One row per key with what importing its rows one after the other leaves: the last value, the last
    that is not null or blank, or the first, as the policy of the column says."""

    def left(c: str) -> Column:
        how = policy.get(c, "create_only")
        at = {"overwrite": order, "keep_if_null": F.when(F.col(c).isNotNull(), order), "keep_if_blank": F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", order)}
        return (F.min_by(c, order) if how == "create_only" else F.max_by(c, at[how])).alias(c)

    return rows.groupBy(*keys).agg(*[left(c) for c in rows.columns if c not in keys])


def with_sections(catalogue: Catalogue, seen: DataFrame, titles: DataFrame, deep: bool = False) -> Catalogue:
    """``catalogue`` with the sections that ``seen`` (source, url) needs: flat ones, or with ``deep`` the donors' trees."""
    if deep:
        prefixes = F.when(F.col("source") == "et_market", "etm-").when(F.col("source") == "in_heat", "inh-")
        rows = categories.deep_tree(seen.select("url", prefixes.alias("prefix")).where("prefix IS NOT NULL"), titles).withColumn("keep_sort", F.lit(True))
        rows = rows.unionByName(categories.flat_categories(seen.where("source = 'vsesezon'"), titles))
    else:
        rows = categories.flat_categories(seen, titles)
    slugs = catalogue["categories"].select(F.col("slug").alias("parent_slug"), F.col("id").alias("known_id"))
    placed = rows.join(slugs, "parent_slug", "left").withColumn("parent_id", F.coalesce("known_id", seed.row_id("categories", "parent_slug")))
    placed = placed.withColumn("id", seed.row_id("categories", "slug"))
    policy = {"name_uk": "overwrite", "parent_id": "overwrite"}
    out = catalogue["categories"]
    for keep, own in ((True, policy), (False, policy | {"sort_order": "overwrite"})):
        out = _merged_by_slug(out, tables.conform(placed.where(F.col("keep_sort") == keep), "categories"), "categories", own)
    return catalogue | {"categories": out}


def _section_slug(deep: bool) -> Column:
    flat = categories.category_slug(F.col("source"), F.col("sourceCategoryUrl"))
    if not deep:
        return flat
    path = F.array_join(F.array_remove(F.split(F.regexp_extract("sourceCategoryUrl", "^[^:]+://[^/?#]+([^?#]*)", 1), "/"), ""), "-")
    prefix = F.when(F.col("source") == "et_market", "etm-").when(F.col("source") == "in_heat", "inh-")
    return F.when(F.col("source").isin("et_market", "in_heat") & flat.isNotNull() & (path != ""), F.substring(F.concat(prefix, path), 1, 200)).otherwise(flat)


def as_plan(df: DataFrame, name: str) -> DataFrame:
    return df


def written_below(folder: str) -> Stage:
    """A stage that writes Parquet tables below a shared folder: JSON is parsed once, every merge runs once."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return stage


def import_products(catalogue: Catalogue, products: DataFrame, titles: DataFrame, publish: bool = True, deep: bool = False, stage: Stage = as_plan) -> tuple[Catalogue, DataFrame]:
    """(new catalogue, rejected products with a ``reason``): ``products`` (file_ord, pos, ...) merged in, sections first,
    then products, images, spec definitions and specs. Importing twice is importing once. Every incoming row is imported
    or rejected: for want of a key, of a known source or a URL of that source, or of its section in the catalogue (own sections come by seeding)."""
    slugged = stage(products.withColumn("section", _section_slug(deep)), "incoming")
    keyless = F.col("source").isNull() | F.col("externalId").isNull()
    taken = slugged.where("section IS NOT NULL AND source IS NOT NULL AND externalId IS NOT NULL")
    seen = taken.where("coalesce(sourceCategoryUrl, '') <> ''").select("source", F.col("sourceCategoryUrl").alias("url"))
    out = with_sections(catalogue, seen, titles, deep)
    out["categories"] = stage(out["categories"], "categories")
    order = F.struct("file_ord", "pos")
    of_section = out["categories"].select(F.col("slug").alias("section"), F.col("id").alias("section_id"))
    # Sections are matched for all rows: those without one are rejected with the reason.
    matched = slugged.join(of_section, "section", "left")
    known = matched.where(F.col("section_id").isNotNull() & ~keyless)
    reason = F.when(keyless, NO_KEY).when(F.col("section").isNull(), NO_SECTION).otherwise(NOT_SEEDED)
    rejected = matched.where(F.col("section_id").isNull() | keyless).withColumn("reason", reason).drop("section", "section_id")
    rows = upsert.import_rows(known, publish, F.col("section_id"), keep=["file_ord", "pos"])
    incoming = reduced(rows, ["external_source", "external_id"], order, upsert.PRODUCT_POLICY).drop("file_ord", "pos")
    merged = upsert.merge(out["products"], tables.conform(incoming, "products"), ["external_source", "external_id"], upsert.PRODUCT_POLICY)
    out["products"] = stage(tables.conform(merged, "products"), "products")
    last = consolidate.last_wins(known, ["source", "externalId"], ["file_ord", "pos"]).drop("position")
    ids = out["products"].select(F.col("external_source").alias("source"), F.col("external_id").alias("externalId"), F.col("id").alias("own_id"))
    last = last.join(ids, ["source", "externalId"])
    touched = last.select(F.col("own_id").alias("product_id"))
    images = upsert.image_rows(last, F.col("own_id")).withColumn("id", seed.row_id("product_images", "product_id", "sort_order"))
    out["product_images"] = upsert.replace_children(out["product_images"], tables.conform(images, "product_images"), "product_id", touched)
    definitions = upsert.spec_definitions(known, ["file_ord", "pos"]).withColumn("id", seed.row_id("spec_definitions", "slug"))
    out["spec_definitions"] = _merged_by_slug(out["spec_definitions"], tables.conform(definitions, "spec_definitions"), "spec_definitions", {"label_uk": "overwrite"})
    out["spec_definitions"] = stage(out["spec_definitions"], "spec_definitions")
    of_definition = out["spec_definitions"].select(F.col("slug").alias("definition"), F.col("id").alias("definition_id"))
    specs = upsert.spec_rows(last, ["source", "externalId"], F.col("own_id")).join(of_definition, "definition").withColumn("id", seed.row_id("product_specs", "product_id", "definition_id"))
    out["product_specs"] = upsert.replace_children(out["product_specs"], tables.conform(specs, "product_specs"), "product_id", touched)
    return out, rejected


def reconciled(catalogue: Catalogue, sources: list[str] = categories.SOURCES) -> Catalogue:
    """``catalogue`` with missing name keys filled and products of several sources merged by similar names.
    Ties go to the older product, then to the smaller id. Merges are kept until a reset."""
    products = maintenance.backfilled_keys(catalogue["products"]).drop("backfilled")
    age = F.concat_ws("|", F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("")), "id")
    roots = products.where(F.col("merged_into_product_id").isNull() & F.col("external_source").isin(sources))
    pointers = similarity.resolve(roots.select(age.alias("id"), F.col("name_norm_key").alias("key"), F.col("external_source").alias("source")), sources)
    bare = pointers.select(*[F.substring_index(c, "|", -1).alias(c) for c in pointers.columns])
    return catalogue | {"products": maintenance.pointed(products, bare)}


def reset(catalogue: Catalogue, everything: bool = False) -> Catalogue:
    """``catalogue`` without imported products, their children and imported sections."""
    products = maintenance.reset_products(catalogue["products"], everything)
    left = products.select(F.col("id").alias("product_id"))
    children = {n: catalogue[n].join(left, "product_id", "left_semi").select(*catalogue[n].columns) for n in ("product_images", "product_specs")}
    return catalogue | children | {"products": products, "categories": maintenance.reset_categories(catalogue["categories"])}


def pruned(catalogue: Catalogue) -> tuple[Catalogue, DataFrame]:
    """(new catalogue, blocked sections): sections without unmerged products go, bottom up; those that still
    hold merged products can't be deleted and are reported."""
    sections, products = catalogue["categories"], catalogue["products"]
    held = products.groupBy(F.col("category_id").alias("id")).agg(F.count_if(F.col("merged_into_product_id").isNull()).alias("unmerged"), F.count("*").alias("n"))
    nodes = sections.select("id", F.col("parent_id").alias("parent"), "slug").join(held, "id", "left")
    kept = trees.prune(nodes, F.coalesce("unmerged", F.lit(0)) > 0, F.col("slug").isin(*categories.PROTECTED))
    gone = kept.where("NOT kept").select("id")
    blocked = gone.join(held.where("n > 0"), "id", "left_semi")
    return catalogue | {"categories": sections.join(gone.join(blocked, "id", "left_anti"), "id", "left_anti").select(*sections.columns)}, blocked


def new_sections(catalogue: Catalogue, wanted: DataFrame) -> tuple[Catalogue, DataFrame]:
    """(new catalogue, rejected): sections ``wanted`` (id, name_uk, parent_id) are created with free slugs; a
    parent that is not there rejects them."""
    known = catalogue["categories"].select(F.col("id").alias("parent_id"))
    bad = wanted.where("parent_id IS NOT NULL").join(known, "parent_id", "left_anti")
    good = wanted.join(bad.select("id"), "id", "left_anti")
    bases = good.select("id", text.slug(F.col("name_uk"), 180, "category").alias("base"))
    slugs = trees.unique_slugs(bases, catalogue["categories"].select("slug")).select("id", "slug")
    return catalogue | {"categories": catalogue["categories"].unionByName(tables.conform(good.join(slugs, "id"), "categories"))}, bad


def rebuild(spark: SparkSession, folder: str, paths: list[str], version: str, publish: bool = True, deep: bool = False, start: Catalogue | None = None) -> tuple[Catalogue, DataFrame]:
    """Reset, seed, import the manifests, reconcile, write the snapshot and make it the current one."""
    tables.check_unpublished(spark, folder, version)
    found = manifests.read_manifests(spark, paths)
    catalogue = seeded(reset(start) if start else empty_catalogue(spark))
    stage = written_below(f"{folder}/{version}-work")
    catalogue, rejected = import_products(catalogue, manifests.products_of(found), section_titles(found), publish, deep, stage)
    path = tables.write_snapshot(reconciled(catalogue), folder, version)
    tables.publish(spark, folder, version)
    return {name: tables.read_table(spark, path, name) for name in catalogue}, rejected
