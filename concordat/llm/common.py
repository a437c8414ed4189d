"""Shared plumbing of the corpus operators: the scratch folder and group counts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..storage import Scratch, shared_dir

__all__ = ["Scratch", "bound_batches", "partitions", "shared_dir"]

#: Rows of an Arrow batch at most. Texts are long: the default of 10,000 rows holds tens of MB in the JVM's direct
#: memory and in each Python worker, and both keep what they once took.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
_BATCHES, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes of an Arrow batch. Plans read both when they run, so they stay lowered:
    a side effect on the caller's session, by which only the size of batches changes, never a result."""
    for key, most in ((_BATCHES, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        held = int(spark.conf.get(key).removesuffix("b"))
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession, times: int = 1) -> int:
    """Group counts follow spark.sql.shuffle.partitions, which is sized with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)
