"""The catalogue's tables: schemas, scans, atomic snapshots and checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tables.
SCHEMAS = {
    "categories": "id string NOT NULL, slug string NOT NULL, name_uk string NOT NULL, name_ru string, description string, parent_id string, sort_order int, created_at timestamp, updated_at timestamp",
    "brands": "id string NOT NULL, slug string NOT NULL, name string NOT NULL, logo_url string, created_at timestamp",
    "products": "id string NOT NULL, slug string NOT NULL, sku string, name_uk string NOT NULL, name_ru string, short_description string, description string, price_uah decimal(12,2), "
    "price_visible boolean, category_id string NOT NULL, brand_id string, published boolean, sort_order int, seo_title string, seo_description string, external_source string, external_id string, "
    "external_url string, source_category_url string, name_norm_key string, merged_into_product_id string, created_at timestamp, updated_at timestamp",
    "product_images": "id string NOT NULL, product_id string NOT NULL, url string NOT NULL, source_url string, alt_uk string, sort_order int",
    "spec_definitions": "id string NOT NULL, slug string NOT NULL, label_uk string NOT NULL, label_ru string, unit string, group_slug string, filterable boolean, sort_order int",
    "product_specs": "id string NOT NULL, product_id string NOT NULL, definition_id string NOT NULL, value_text string, value_number decimal(18,6)",
}
#: Column sets that must be unique where no column is null. Fixed values.
UNIQUE = {
    "categories": (("id",), ("slug",)), "brands": (("id",), ("slug",)), "products": (("id",), ("slug",), ("sku",), ("external_source", "external_id")),
    "product_images": (("id",),), "spec_definitions": (("id",), ("slug",)), "product_specs": (("id",), ("product_id", "definition_id")),
}
#: (table, column, table it refers to). Fixed values.
REFERENCES = (
    ("categories", "parent_id", "categories"), ("products", "category_id", "categories"), ("products", "brand_id", "brands"), ("products", "merged_into_product_id", "products"),
    ("product_images", "product_id", "products"), ("product_specs", "product_id", "products"), ("product_specs", "definition_id", "spec_definitions"),
)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of a table; columns that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty(df.sparkSession, name).schema])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a snapshot, written whole or in parts."""
    return read_parts(spark, folder, name) if exists(spark, f"{folder}/_parts") else spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


#: Parts of the tables that grow with the products, and the columns by which their rows are dealt to them; other tables are one part.
PARTS = 64
PART_KEYS = {"products": ("external_source", "external_id"), "product_images": ("product_id",), "product_specs": ("product_id",)}
_LISTING = "name string, part int, version string"


def part_of(name: str, *key: Column) -> Column:
    """The part of a table's row with the given ``key`` (else by its own columns)."""
    columns = key or [F.col(c) for c in PART_KEYS.get(name, ())]
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int") if columns else F.lit(0)


def listing(spark: SparkSession, path: str) -> dict[tuple[str, int], str | None]:
    """Which version holds each part of each table, for a snapshot written in parts; None for a part without rows. As many entries as there are
    tables and parts, whatever their size."""
    return {(r["name"], r["part"]): r["version"] for r in spark.read.schema(_LISTING).parquet(f"{path}/_parts").collect()}


def read_parts(spark: SparkSession, path: str, name: str, parts: Iterable[int] | None = None) -> DataFrame:
    """Some parts of a table, or all, of a snapshot written in parts."""
    wanted, folder = None if parts is None else set(parts), path.rpartition("/")[0]
    paths = [f"{folder}/{v}/{name}/part={p}" for (n, p), v in sorted(listing(spark, path).items()) if n == name and v and (wanted is None or p in wanted)]
    return spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else empty(spark, name)


def write_parts(changed: dict[str, tuple[DataFrame, Iterable[int]]], folder: str, version: str, base: str | None) -> str:
    """A snapshot that holds only what ``changed`` (all rows of the given parts of a table) and names the versions that hold the other
    parts, those of the snapshot ``base``: no file of an untouched part is read or written. Published as any other."""
    spark = next(iter(changed.values()))[0].sparkSession
    check_unpublished(spark, folder, version)
    held = listing(spark, base) if base else {}
    for name, (df, parts) in changed.items():
        path = f"{folder}/{version}/{name}"
        # One file for each part, dealt by the part's number.
        conform(df, name).withColumn("part", part_of(name)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        filled = {r["part"] for r in spark.read.parquet(path).select(F.col("part").cast("int").alias("part")).distinct().collect()} if exists(spark, path, "part=*") else set()
        if not filled <= set(parts):
            raise ValueError(f"rows of parts of {name} that were not to change: {sorted(filled - set(parts))}")
        held |= {(name, p): version if p in filled else None for p in parts}
    rows = [(n, p, v) for (n, p), v in sorted(held.items())]
    spark.createDataFrame(rows, _LISTING).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version}/_parts")
    return f"{folder}/{version}"


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a running database; with a numeric key and (lower, upper, partitions), read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return reader.load()


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """All tables below ``folder/version``; readers see the version only once the caller publishes it
    with ``publish``, so a run that dies half-way changes nothing and can be repeated. A version that was published is never written again."""
    check_unpublished(next(iter(tables.values())).sparkSession, folder, version)
    for name, df in tables.items():
        conform(df, name).write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    return f"{folder}/{version}"


def check_unpublished(spark: SparkSession, folder: str, version: str) -> None:
    """An error if ``version`` was published in ``folder``: readers may use it, and it may be what the new one is made from."""
    if _has_versions(spark, folder) and not _versions(spark, folder).where(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is published in {folder}; give the new snapshot another name")


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Makes ``version`` the current snapshot: a row is added to the published versions, and nothing is ever replaced, so
    a run that dies here leaves the version before."""
    number = 1 + (_versions(spark, folder).agg(F.max("number")).first()[0] or 0) if _has_versions(spark, folder) else 1
    spark.createDataFrame([(number, version)], _VERSION).coalesce(1).write.mode("append").parquet(f"{folder}/_versions")


_VERSION = "number long, version string"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share: the session's spark.checkpoint.dir, or else the context's checkpoint
    folder. A local master without either gets a temporary one, a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="merchloom-")
    return f"{shared}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, folder: str, pattern: str | None = None) -> bool:
    """Whether a folder of any file system that Spark reads is there, and in it something that fits the ``pattern``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}" if pattern else folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.globStatus(path)) if pattern else files.exists(path)


def _has_versions(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/_versions")


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_VERSION).parquet(f"{folder}/_versions")


def is_published(spark: SparkSession, folder: str) -> bool:
    """Whether a snapshot was published in ``folder``."""
    return _has_versions(spark, folder) and not _versions(spark, folder).isEmpty()


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the snapshot that was published last."""
    return f"{folder}/{_versions(spark, folder).orderBy(F.col('number').desc(), F.col('version').desc()).first()['version']}"


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of tables that nothing reads any more, in any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): broken unique keys and references of the given tables; a sound catalogue has none above 0."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "rule string, n long")
    for name, df in tables.items():
        for columns in UNIQUE[name]:
            full = df.dropna(subset=list(columns)).groupBy(*columns).count().where("count > 1")
            out = out.union(full.agg(F.count("*")).select(F.lit(f"{name}: {', '.join(columns)} unique"), "count(1)"))
    for name, column, other in REFERENCES:
        if name in tables and other in tables:
            lost = tables[name].where(F.col(column).isNotNull()).join(tables[other].select(F.col("id").alias(column)), column, "left_anti")
            out = out.union(lost.agg(F.count("*")).select(F.lit(f"{name}: {column} refers to {other}"), "count(1)"))
    return out
