"""Folders of stored media as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media


def list_folder(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """(name, path, size, modified, safe): the files of a folder, or with ``nested`` of all folders below it too, in any file system that Spark reads.

    Only the listing is read, which Spark spreads over tasks where there are many folders; no file is opened, as their contents are not
    selected. Names that begin with a dot or an underscore are hidden and left out; ``safe`` tells names that media may have (64
    hexadecimal digits and a known ending). Files without a byte hold no image and are left out too, so that they count as missing.
    A folder without such files gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", nested).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).withColumn("safe", media.is_safe_name(F.col("name")))


def stored_files(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """(name): the files that ``maintenance.media_status`` and ``missing_files`` ask for."""
    return list_folder(spark, folder, nested).where("safe").select("name").distinct()
