"""What every operator with Python tasks needs: a package that workers can import, and batches they can hold."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def reach_workers(spark: SparkSession) -> None:
    """Let workers import this package: where it is not installed on them they look where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker when values are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
