"""The shared scratch folder of a session, and tables in it that cut a lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; a local one if that is unset and so is Spark."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="concordat-")
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"file://{local}"


class Scratch:
    """Parquet tables in the shared folder; ``drop`` deletes one that is no longer read, the rest go at exit."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/concordat-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._drop_all)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def measured(self, df: DataFrame, *what: Column) -> tuple[DataFrame, str, dict]:
        """``write``, and the aggregates ``what`` with the number of rows, ``n``, taken on the way."""
        seen, what = Observation(), (F.count(F.lit(1)).alias("n"), *what)
        held, path = self.write(df.observe(seen, *what))
        found = seen.get  # empty if the plan turned out to be an empty relation
        return held, path, found if "n" in found else held.agg(*what).first().asDict()

    def drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _drop_all(self) -> None:
        with contextlib.suppress(Exception):
            self.drop(self.root)
