"""Scraped manifests: JSON documents with nested products."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consolidate

LISTING_DDL = (
    "source string, externalId string, sourceUrl string, slug string, nameUk string, sku string, priceUah double, priceVisible boolean, "
    "imageUrl string, bitrixOfferId string, sourceCategoryUrl string"
)
PRODUCT_DDL = f"{LISTING_DDL}, shortDescription string, descriptionHtml string, images array<struct<url:string,alt:string>>, specs array<struct<`group`:string,label:string,value:string>>"
_STATS = "array<struct<categoryUrl:string,title:string,pages:int,{rows}:int>>"
MANIFEST_DDL = (
    f"scrapedAt string, listingUrl string, products array<struct<{PRODUCT_DDL}>>, "
    "etMarket struct<pagination:struct<currentPage:int,totalPages:int,totalProducts:int,showingFrom:int,showingTo:int>,pagesScraped:int,"
    "filters:array<struct<id:string,name:string,values:array<struct<filterKey:string,label:string,count:int,filterUrl:string>>,priceRangeUah:struct<min:int,max:int>>>>, "
    f"inHeat struct<seedUrl:string,pathPrefixes:array<string>,categoryUrls:array<string>,perCategory:{_STATS.format(rows='listingRows')}>, "
    f"etMarketCrawl struct<seedUrls:array<string>,categoryUrls:array<string>,perCategory:{_STATS.format(rows='listingRows')}>, "
    f"vsesezon struct<seedUrls:array<string>,groupUrls:array<string>,perCategory:{_STATS.format(rows='productRows')}>"
)
_META = ("etMarket", "inHeat", "etMarketCrawl", "vsesezon")


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The manifests of ``paths``, each with its place in the list (file_ord). The schema is given, never inferred."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.schema(MANIFEST_DDL).option("multiLine", True).json(path).withColumn("file_ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def products_of(manifests: DataFrame) -> DataFrame:
    """One row per product, with file_ord and position: later rules depend on the order. Products of documents that hold a part
    of a manifest have the places that stand there."""
    if "places" not in manifests.columns:
        return manifests.select("file_ord", F.posexplode("products").alias("pos", "p")).select("file_ord", "pos", "p.*")
    parts = manifests.select("file_ord", "places", F.posexplode("products").alias("at", "p"))
    return parts.select("file_ord", F.coalesce(F.try_element_at("places", F.col("at") + 1), F.col("at")).alias("pos"), "p.*")


def merged_products(manifests: DataFrame) -> DataFrame:
    """The products of several manifests, one per source and external id: the last one's values at the place of the first."""
    last = consolidate.last_wins(products_of(manifests), ["source", "externalId"], ["file_ord", "pos"])
    return last.select(F.col("position.file_ord").alias("file_ord"), F.col("position.pos").alias("pos"), *[c for c in last.columns if c not in ("position", "file_ord", "pos")])


def write_documents(products: DataFrame, meta: DataFrame, path: str, size: int = 500) -> None:
    """A manifest of any size as JSON documents, one in a line: ``products`` (file_ord, pos, ...) in documents of at most ``size``, each with
    the places of its products (their order in the whole), and ``meta`` (a row of ``merged_meta``) in a document of its own.
    ``read_documents`` reads it back whole; no task holds more than a document."""
    place = (F.col("file_ord").cast("long") * 2**40 + F.col("pos")).alias("place")
    fields = own_fields(products)
    part = F.struct("file_ord", F.floor(F.col("pos") / size).alias("n"))
    parts = products.select(part.alias("part"), place, F.struct(*fields).alias("product")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "product"))).alias("held"))
    documents = parts.select(F.col("held.place").alias("places"), F.col("held.product").alias("products"))
    both = documents.unionByName(meta.withColumn("products", F.array().cast(documents.schema["products"].dataType)), allowMissingColumns=True)
    both.write.mode("errorifexists").json(path)


def own_fields(products: DataFrame) -> list[str]:
    """The columns of ``products`` that belong to a manifest's product."""
    return [c for c in products.columns if c not in ("file_ord", "pos", "position")]


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifests that ``write_documents`` wrote, in the shape of ``read_manifests`` with the ``places`` of their products."""
    read = [spark.read.schema(f"{MANIFEST_DDL}, places array<bigint>").json(path).withColumn("file_ord", F.lit(i)) for i, path in enumerate(paths)]
    return reduce(DataFrame.unionByName, read)


def facets_of(manifests: DataFrame) -> DataFrame:
    """One row per facet value; groups with a price range only have a row without a value."""
    groups = manifests.select("file_ord", F.posexplode("etMarket.filters").alias("group_pos", "g"))
    return groups.select("file_ord", "group_pos", "g.id", "g.name", F.posexplode_outer("g.values").alias("pos", "v"), "g.priceRangeUah").select(
        "file_ord", "group_pos", "id", "name", "pos", "v.*", "priceRangeUah"
    )


def merged_meta(manifests: DataFrame) -> DataFrame:
    """One row: the first manifest's time and URL, and of every crawl block the first that is there."""
    order = F.col("file_ord")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("scrapedAt", "listingUrl", *_META)]
    return manifests.agg(*first)


def write_manifest(products: DataFrame, path: str, scraped_at: str, listing_url: str, meta: dict[str, str] | None = None) -> None:
    """``products`` as JSON lines, in their order if they have file_ord and pos; the run's time is a parameter.
    Parts are written by the tasks: a manifest of any size needs no single task."""
    extra = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    products.select("*", F.lit(scraped_at).alias("scrapedAt"), F.lit(listing_url).alias("listingUrl"), *extra).write.mode("overwrite").json(path)


def read_url_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct non-blank lines (url)."""
    return spark.read.text(paths).select(F.trim("value").alias("url")).where("url <> ''").distinct()


def read_pages(spark: SparkSession, paths: list[str], base_url: str | None = None) -> DataFrame:
    """Saved HTML files as (url, html); the URL is the given one or the file's path."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))
    return files.select(F.lit(base_url).alias("url") if base_url else F.col("file").alias("url"), "html")


def batches(products: DataFrame, size: int = 50) -> DataFrame:
    """``products`` with the number of the checkpoint batch of each row by its ordinal (file_ord, pos): a
    resumed run reads what is written and leaves those batches out. Positions number rows within a
    file, so no window over all rows is needed."""
    return products.withColumn("batch", F.floor(F.col("pos") / size).cast("int"))


def write_batches(products: DataFrame, folder: str, enrich: Callable[[DataFrame], DataFrame], size: int = 50, waves: int = 16) -> None:
    """``products`` (file_ord, pos, ...) with their details, as a table below ``folder`` with one partition for each batch of ``size`` places of a file.

    Batches that are there are left alone and not enriched again. The others are written in ``waves`` jobs, each of which puts
    whole partitions in place when it has ended: a run that dies has lost the wave that it was in, and the next run does what
    is missing. ``enrich`` gets and gives rows with file_ord and pos. Batches that it leaves empty are tried again by every run."""
    spark, keys = products.sparkSession, ["file_ord", "batch"]
    left = batches(products, size)
    done = written_batches(spark, folder)
    if done is not None:
        left = left.join(done, keys, "left_anti")
    wave = F.pmod(F.xxhash64(*keys), F.lit(waves))
    for k in range(waves):
        part = batches(enrich(left.where(wave == k).drop("batch")), size)
        # A batch is one task's, so one file; dynamic overwriting replaces the partitions of this wave only.
        part.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


def written_batches(spark: SparkSession, folder: str) -> DataFrame | None:
    """(file_ord, batch) of the batches below ``folder``, from the names of the partitions; None if nothing was written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/file_ord=*/batch=*")) if files.exists(path) else None
    if not found:
        return None
    return spark.read.parquet(folder).select(F.col("file_ord").cast("int"), F.col("batch").cast("int")).distinct()


def ordinals(products: DataFrame) -> DataFrame:
    """0-based ordinals over all files: positions within a file plus the sizes of the files before,
    which are as few rows as there are files."""
    sizes = products.groupBy("file_ord").agg((F.max("pos") + 1).alias("n"))
    before = sizes.select(F.col("file_ord").alias("of_file"), F.coalesce(F.sum("n").over(Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return products.join(before, F.col("file_ord") == F.col("of_file")).withColumn("ordinal", F.col("before") + F.col("pos")).drop("of_file", "before")
