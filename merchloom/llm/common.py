"""Helpers shared by the training-data operators.

Text conventions: words are runs of characters other than the six ASCII white
space characters, and only A-Z are lower-cased. Both are byte-wise operations on
UTF-8, so the per-row helpers work on bytes and never decode where they need not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import bound_batches

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of the folder ``sf_dir``."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, the context's checkpoint folder; a local master
    gets a temporary one, and a cluster an error: its executors could not read what the others wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="merchloom-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None, counted: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage
    and survives lost executors. Fewer rows than were written are an error: then some files are in a folder that
    is not shared; ``counted`` is False only where an earlier table has shown it. ``replaces``: an earlier such
    table that nothing reads any more; its files go."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = Observation()
    (df.observe(rows, F.count(F.lit(1)).alias("n")) if counted else df).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    # Spark writes a file at least, even of an empty table. The count reads the ends of the files only.
    if not written.inputFiles() or (counted and written.count() != rows.get["n"]):
        raise RuntimeError(f"not all of {name} can be seen in {path}: the folder is not shared")
    if replaces is not None and (files := replaces.inputFiles()):
        old = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return written


#: Bits of a broadcast bitmap: 16 MiB, whatever it stands for.
BITMAP_BITS = 1 << 27


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> tuple[np.ndarray, int]:
    """(bytes of a bitmap in which the bit pmod(key, bits) is set for every key that is not null, rows of ``keys``).
    Bits are gathered by Spark; at most ``bits`` / 8 bytes reach the driver, however many keys there are."""
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    group = F.coalesce(F.bitmap_bucket_number(place), F.lit(1).cast("long"))
    rows = keys.groupBy(group.alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"), F.count("*").alias("n")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for part, piece in zip(rows["part"].to_pylist(), rows["bits"].to_pylist()):
        own = out[(part - 1) * 4096 : part * 4096]
        own |= np.frombuffer(piece, np.uint8)[: len(own)]
    return out, sum(rows["n"].to_pylist())


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some signed 64-bit keys have their bit in a table of ``bitmap``."""
    place = np.mod(keys, len(table) * 8)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def marked(spark: SparkSession, table: np.ndarray) -> Callable[[Column], Column]:
    """A test of 64-bit key columns against a table of ``bitmap``, which is broadcast."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def has(keys):
        import pandas as pd

        return pd.Series(has_bit(shared.value, keys.to_numpy()))

    return has


def fold(column: Column, divisor: int) -> Column:
    """crc32(id as text) mod ``divisor``; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, under the given names, so that extra columns never clash.
    Columns that have their name already stay as they are: an alias would hide that exchanges are equal."""
    return df.select(*[df[source] if source == name else df[source].alias(name) for name, source in columns.items()])


def planes(x: np.ndarray) -> bytes:
    """The bytes of some numbers, first bytes first: planes of zeros compress to nothing in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def numbers(blobs: list[bytes], kind: type) -> np.ndarray:
    """The numbers of some blobs of planes."""
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel() for b in blobs]) if blobs else np.empty(0, kind)
