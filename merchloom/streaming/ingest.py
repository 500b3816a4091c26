"""Manifests that keep arriving in a folder, imported as they come.

Structured Streaming remembers which files were read, so a run that is stopped goes on where it was.
Every batch becomes a snapshot of its own number, published when it is complete: a batch that is
replayed after a failure imports the same rows into the snapshot before it, which changes nothing.
A batch reads and writes only the parts of the catalogue that its products are in; its snapshot names the versions that hold
the others. Reconciling reads the names of all products, and rewrites a part only where a row of it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import upsert
from ..plans import imports
from ..sources import manifests, tables


def apply_batch(found: DataFrame, number: int, folder: str, publish: bool = True, deep: bool = False, reconcile: bool = True) -> None:
    """One batch of manifests (with their ``file``) imported into the current snapshot of ``folder``, and reconciled with what is there.
    Files of a batch are taken in the order of their names; the tables it worked with go when it is published."""
    spark = found.sparkSession
    # Only names are ordered, no more than a batch has files; manifests are joined to their numbers.
    names = found.select("file").distinct()
    numbered = names.withColumn("file_ord", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))
    ordered = found.join(numbered, "file").drop("file")
    version = f"batch-{number:09d}"
    base = tables.current(spark, folder) if tables.is_published(spark, folder) else None
    if base and base.endswith(version):  # the batch was published, but not yet marked as done
        return
    work = f"{folder}/work/{version}"
    stage = imports.written_below(work)
    incoming, titles = stage(manifests.products_of(ordered), "products_in"), stage(imports.section_titles(ordered), "titles_in")
    every = set(range(tables.PARTS))
    if base and tables.exists(spark, f"{base}/_parts"):
        own, children = touched(incoming, base)
        before = {name: tables.read_parts(spark, base, name, own if name == "products" else children if name in tables.PART_KEYS else None) for name in tables.SCHEMAS}
    else:  # the first batch, or one that comes after a snapshot written whole
        own = children = every
        before = {name: tables.read_table(spark, base, name) for name in tables.SCHEMAS} if base else imports.seeded(imports.empty_catalogue(spark))
    after, rejected = imports.import_products(before, incoming, titles, publish, deep, stage)
    products = after["products"]
    if reconcile:
        others = tables.read_parts(spark, base, "products", every - own) if own != every else tables.empty(spark, "products")
        products = stage(imports.reconciled({"products": products.unionByName(others)})["products"], "reconciled")
        own = own | changed_parts(others, products)
        products = products.where(tables.part_of("products").isin(sorted(own)))
    parts = {"products": own, "product_images": children, "product_specs": children}
    written = {name: (products if name == "products" else df, parts.get(name, {0})) for name, df in after.items() if name != "brands" or own == every or not base}
    tables.write_parts(written, folder, version, base if base and tables.exists(spark, f"{base}/_parts") else None)
    rejected.write.mode("overwrite").json(f"{folder}/rejected/{version}")
    tables.publish(spark, folder, version)
    tables.remove(spark, work)


def touched(incoming: DataFrame, base: str) -> tuple[set[int], set[int]]:
    """(parts of the product table, parts of its children's tables) that hold the products of ``incoming``."""
    spark = incoming.sparkSession
    keys = incoming.select(F.col("source").alias("external_source"), F.col("externalId").alias("external_id")).distinct()
    own = _numbers(keys.select(tables.part_of("products").alias("part")))
    stored = tables.read_parts(spark, base, "products", own).join(keys, ["external_source", "external_id"], "left_semi").select("id")
    ids = stored.union(incoming.select(upsert.product_id().alias("id")))
    return own, _numbers(ids.select(tables.part_of("product_images", F.col("id")).alias("part")))


def changed_parts(old: DataFrame, new: DataFrame) -> set[int]:
    """The parts of the product table in which a row of ``old`` has another canonical product or key in ``new``."""
    fresh = new.select("id", F.col("merged_into_product_id").alias("to"), F.col("name_norm_key").alias("key"))
    same = F.col("merged_into_product_id").eqNullSafe(F.col("to")) & F.col("name_norm_key").eqNullSafe(F.col("key"))
    return _numbers(old.join(fresh, "id").where(~same).select(tables.part_of("products").alias("part")))


def _numbers(parts: DataFrame) -> set[int]:
    """Distinct numbers of parts, at most ``tables.PARTS``."""
    return {r["part"] for r in parts.distinct().collect()}


def import_arriving(spark: SparkSession, source: str, folder: str, max_files: int = 100, once: bool = True, **options) -> StreamingQuery:
    """Starts importing the manifests below ``source`` into ``folder``: all that are there and then an end, or
    without ``once`` for ever. At most ``max_files`` make a batch."""
    files = spark.readStream.schema(manifests.MANIFEST_DDL).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(source)
    named = files.withColumn("file", F.input_file_name())
    writer = named.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, folder, **options)).option("checkpointLocation", f"{folder}/_progress")
    return (writer.trigger(availableNow=True) if once else writer).start()
