"""Bounds of the Arrow batches that go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Most bytes of an Arrow batch where the session sets no bound of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: Spark's 10,000 rows of long texts are held several times over, by the JVM and by each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)
