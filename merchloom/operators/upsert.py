"""Idempotent merges: a catalogue and incoming rows make a new catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: How a column of an existing row is updated.
#: overwrite: always; keep_if_null: unless the new value is null; keep_if_blank: unless it is null or empty;
#: create_only: never. Columns without a policy are create_only.
POLICIES = ("overwrite", "keep_if_null", "keep_if_blank", "create_only")

#: The policy of imported products. Fixed values.
PRODUCT_POLICY = {
    "slug": "overwrite", "name_uk": "overwrite", "name_norm_key": "overwrite", "price_visible": "overwrite", "published": "overwrite", "category_id": "overwrite",
    "sku": "keep_if_null", "short_description": "keep_if_null", "description": "keep_if_null", "price_uah": "keep_if_null",
    "external_url": "keep_if_blank", "source_category_url": "keep_if_null", "seo_title": "create_only",
}


def updated(old: Column, new: Column, policy: str) -> Column:
    if policy == "overwrite":
        return new
    if policy == "keep_if_null":
        return F.coalesce(new, old)
    if policy == "keep_if_blank":
        return F.coalesce(F.nullif(new, F.lit("")), old)
    return old


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """``current`` with ``incoming`` (one row per key) merged in, column by column: rows that exist follow
    the policy, rows that do not are created as they come. Merging twice is merging once."""
    o, n = current.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    exists, comes = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c not in incoming.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
            out.append(F.when(exists & comes, updated(old, new, policy.get(c, "create_only"))).when(comes, new).otherwise(old).alias(c))
    return o.join(n, on, "full_outer").select(*out)


def replace_children(current: DataFrame, incoming: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """The children of every touched parent are the incoming ones; other parents keep theirs.
    ``touched``: the parents that were imported, some perhaps without children."""
    touched = (touched if touched is not None else incoming).select(parent).distinct()
    return current.join(touched, parent, "left_anti").unionByName(incoming)


def patch(current: DataFrame, patches: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Tri-state updates: ``patches`` has the key, new values and ``present_fields``, the names of the fields
    that were sent; a field that was sent as null becomes null, one that was not sent stays. Of several patches of
    one key, each field takes the last value sent, by the column ``order`` (by the patches' contents without one)."""
    fields = [c for c in current.columns if c != key and c in patches.columns]
    turn = F.col(order) if order else F.to_json(F.struct(*sorted(set(fields) | {"present_fields"})))
    last = [F.max(F.when(F.array_contains("present_fields", c), F.struct(turn.alias("turn"), F.col(c).alias("value")))).alias(f"__{c}") for c in fields]
    sent = patches.groupBy(F.col(key).alias("__key")).agg(*last) if last else patches.select(F.col(key).alias("__key")).distinct()
    out = [F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns]
    return current.join(sent, F.col(key) == F.col("__key"), "left").select(*out)


#: Fields of a product that take no null, and those of which a blank text is null. Fixed values.
NEVER_NULL = ("slug", "name_uk", "name_norm_key", "price_visible", "published", "sort_order", "category_id")
BLANK_IS_NULL = ("sku", "external_source", "external_id", "external_url", "source_category_url")


def product_patches(patches: DataFrame) -> DataFrame:
    """``patches`` of products as a form sends them (``present_fields`` and text or typed columns, ``price_uah`` as text)
    as rows for ``patch``: texts of identifiers are trimmed and blank ones null, a decimal comma is a point, a new
    name brings its key unless a key that is not blank was sent. Nulls of fields that take none, and blank prices, count
    as not sent; a row whose price is no number is left out as a whole, and ``rejected_patches`` returns it."""
    sent = lambda c: F.array_contains("present_fields", c)
    value = {c: F.col(c) for c in patches.columns if c != "present_fields"}
    given = {c: sent(c) for c in value}
    for c in (*BLANK_IS_NULL, "slug"):
        if c in value:
            value[c] = text.js_trim(value[c])
            value[c] = F.nullif(value[c], F.lit("")) if c != "slug" else value[c]
    own = F.nullif(text.js_trim(F.col("name_norm_key")), F.lit("")) if "name_norm_key" in value else F.lit(None).cast("string")
    own = F.when(sent("name_norm_key"), own)
    if "name_uk" in value:
        own = F.coalesce(own, F.when(sent("name_uk"), text.name_key(F.col("name_uk"))))
    value["name_norm_key"], given["name_norm_key"] = own, F.lit(True)
    readable = F.lit(True)
    if "price_uah" in value:
        _, value["price_uah"], given["price_uah"] = _sent_price()
        readable = ~_bad_price()
    given |= {c: given[c] & value[c].isNotNull() for c in NEVER_NULL if c in value}
    present = F.array_compact(F.array(*[F.when(ok, F.lit(c)) for c, ok in given.items()]))
    return patches.where(readable).select(*[v.alias(c) for c, v in value.items()], present.alias("present_fields"))


def _sent_price() -> tuple[Column, Column, Column]:
    """(trimmed text, number, whether a price was sent) of a patch."""
    raw = text.js_trim(F.col("price_uah"))
    return raw, F.regexp_replace(raw, "^([^,]*),", "$1.").try_cast("decimal(12,2)"), F.array_contains("present_fields", "price_uah") & (raw.isNull() | (raw != ""))


def _bad_price() -> Column:
    raw, number, given = _sent_price()
    return F.coalesce(given & raw.isNotNull() & number.isNull(), F.lit(False))


def rejected_patches(patches: DataFrame) -> DataFrame:
    """The rows of ``patches`` that ``product_patches`` leaves out, as they came, with the ``reason``: every patch is in one of the two."""
    bad = _bad_price() if "price_uah" in patches.columns else F.lit(False)
    return patches.where(bad).withColumn("reason", F.lit("the price is no number"))


def import_rows(products: DataFrame, publish: bool, category: Column, keep: list[str] | None = None) -> DataFrame:
    """Manifest products as rows of the product table, beside the columns to ``keep``; ids are hashes of source
    and external id."""
    c = F.col
    return products.select(
        *(keep or []),
        product_id().alias("id"),
        text.product_slug(c("source"), c("externalId")).alias("slug"),
        text.product_sku(c("sku"), c("source"), c("externalId")).alias("sku"),
        c("nameUk").alias("name_uk"),
        F.nullif(text.name_key(c("nameUk")), F.lit("")).alias("name_norm_key"),
        c("shortDescription").alias("short_description"),
        c("descriptionHtml").alias("description"),
        c("priceUah").cast("decimal(12,2)").alias("price_uah"),
        c("priceVisible").alias("price_visible"),
        category.alias("category_id"),
        F.lit(publish).alias("published"),
        c("source").alias("external_source"),
        c("externalId").alias("external_id"),
        F.nullif(text.js_trim(c("sourceUrl")), F.lit("")).alias("external_url"),
        text.js_trim(c("sourceCategoryUrl")).alias("source_category_url"),
        F.substring("nameUk", 1, 200).alias("seo_title"),
    )


def product_id() -> Column:
    """The id of an imported product."""
    return F.sha2(F.concat_ws("|", "source", "externalId"), 256)


def image_rows(products: DataFrame, of: Column | None = None) -> DataFrame:
    """(product_id, url, alt_uk, sort_order): images in their order. ``of``: the product's id, where it is stored."""
    exploded = products.select((product_id() if of is None else of).alias("product_id"), F.posexplode("images").alias("sort_order", "image"))
    return exploded.select("product_id", F.col("image.url").alias("url"), F.col("image.alt").alias("alt_uk"), "sort_order")


def _specs(products: DataFrame, order: list[str], of: Column | None = None) -> DataFrame:
    rows = products.select(F.struct(*order).alias("at"), (product_id() if of is None else of).alias("product_id"), F.posexplode("specs").alias("pos", "spec"))
    return rows.select("at", "product_id", "pos", "spec.*").withColumn("definition", text.slug(F.col("label"), 80, "spec"))


def spec_definitions(products: DataFrame, order: list[str]) -> DataFrame:
    """Definitions that the products bring: group, filter flag and position of the first row that has the
    label's slug (100 and its place among that product's specs), the label of the last one."""
    rows = products.select(F.struct(*order).alias("of"), F.posexplode("specs").alias("pos", "spec")).select(F.struct(F.col("of").alias("at"), "pos").alias("at"), "spec.group", "spec.label")
    # Labels repeat: each is made a slug once, and not in every row.
    labels = rows.groupBy("label", "group").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")).withColumn("definition", text.slug(F.col("label"), 80, "spec"))
    first = F.struct(F.when(F.nullif("group", F.lit("")).isNotNull(), text.slug(F.col("group"), 60, "")).alias("group_slug"), text.filterable(F.col("label")).alias("filterable"), (F.col("first_at.pos") + 100).alias("sort_order"))
    agg = labels.groupBy(F.col("definition").alias("slug")).agg(F.max_by(text.js_trim(F.col("label")), "last_at").alias("label_uk"), F.min_by(first, "first_at").alias("f"))
    return agg.select("slug", "label_uk", "f.*")


def spec_rows(products: DataFrame, order: list[str], of: Column | None = None) -> DataFrame:
    """(product_id, definition, value_text, value_number): of equal definitions in a product the last wins."""
    rows = _specs(products, order, of).groupBy("product_id", "definition").agg(F.max_by("value", "pos").alias("value"))
    return rows.select("product_id", "definition", text.js_trim(F.col("value")).alias("value_text"), text.spec_number(F.col("value")).alias("value_number"))


def next_order(children: DataFrame, parent: str) -> DataFrame:
    """The position of a child that is added to each parent."""
    return children.groupBy(parent).agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("next_order"))


def owned(children: DataFrame, patches: DataFrame, parent: str, key: str) -> DataFrame:
    """Patches of children that belong to the parent they name; the others are left out."""
    return patches.join(children.select(parent, key), [parent, key], "left_semi")


def edited_specs(specs: DataFrame, patches: DataFrame, definitions: DataFrame) -> DataFrame:
    """The specs of the products that ``patches`` (product_id, id, value_text, value_number, present_fields) name, with the patches applied, and each
    row's ``place`` in its product by the sort order of its definition. Patches of another product's specs do nothing; a value that was not sent stays, one sent
    as null becomes null, and a number that is not finite counts as not sent."""
    own = owned(specs, patches, "product_id", "id")
    number = F.col("value_number").cast("double")
    odd = number.isNotNull() & (F.isnan(number) | (F.abs(number) == float("inf")))
    sent = F.when(odd, F.array_remove("present_fields", "value_number")).otherwise(F.col("present_fields"))
    sound = own.select("id", "value_text", F.when(~odd, F.col("value_number")).cast(dict(specs.dtypes)["value_number"]).alias("value_number"), sent.alias("present_fields"))
    edited = patch(specs.join(patches.select("product_id").distinct(), "product_id", "left_semi"), sound, "id")
    placed = edited.join(definitions.select(F.col("id").alias("definition_id"), F.col("sort_order").alias("__order")), "definition_id", "left")
    # A product has few specs: numbered within the product.
    place = F.row_number().over(Window.partitionBy("product_id").orderBy("__order", "id"))
    return placed.withColumn("place", place).select(*specs.columns, "place")
