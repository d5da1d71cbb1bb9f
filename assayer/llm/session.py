"""Session settings for rows that hold whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows an Arrow batch: whole texts make large rows, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches, unless the session already has smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark
