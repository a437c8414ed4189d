"""An extension beyond one-shot scans: listings arrive as a stream and fold into manifest snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan
from ..sources import manifest

LISTING = T.StructType([T.StructField("drive_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("content_hash", T.StringType())])


def listings(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet listings dropped into a folder, as a stream."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fold(stream: DataFrame, root: str, checkpoint: str, content_hash: Column | None = None):
    """Merges every micro-batch into the newest snapshot under ``root`` and writes the next one, ``root/<batch>``.

    Batches only add and change files; a full scan is what finds vanished ones. A batch that runs again after a
    failure reads the same predecessor and replaces its own snapshot, so the result is exactly once.
    """
    hashed = F.col("content_hash") if content_hash is None else content_hash

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = manifest.read(spark, f"{root}/{number - 1}")
        newest = batch.groupBy("drive_id", "path").agg(F.max_by(F.struct("size", "mtime", "content_hash"), F.struct("mtime", "size", "content_hash")).alias("f")).select("drive_id", "path", "f.*")
        seen = scan.hashed(newest, before, hashed)
        kept = before.select("drive_id", "path", "version_vector", "corrupted", "inode")
        new = seen.join(kept, manifest.KEY, "left").select("drive_id", "path", "hash", "size", "mtime", F.coalesce("version_vector", F.lit("{}")).alias("version_vector"), F.lit(False).alias("tombstone"), F.coalesce("corrupted", F.lit(False)).alias("corrupted"), "inode")
        manifest.merge(before, new).write.mode("overwrite").parquet(f"{root}/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
