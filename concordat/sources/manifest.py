"""Manifest, drive registry and operation log as DataFrames and Parquet snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vv

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """Column names and types, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(", "))])


STATES = _schema("drive_id string, path string, hash string, size bigint, mtime bigint, version_vector string, tombstone boolean, corrupted boolean, inode bigint")
DRIVES = _schema("drive_id string, last_seen bigint")
NODES = _schema("drive_id string, path string, level int, hash string")
LOG = _schema("id bigint, operation string, path string, timestamp bigint, completed boolean")
KEY = ["drive_id", "path"]


def read(spark: SparkSession, path: str, schema: T.StructType = STATES) -> DataFrame:
    """A snapshot; an empty table if there is none yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write(df: DataFrame, path: str, by_drive: bool = False) -> None:
    """A new snapshot; written whole to a folder of its own before anything reads it."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy("drive_id") if by_drive else writer).parquet(path)


def merge(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Upsert: rows of ``new`` (one a key) replace those of ``old`` with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def delete(states: DataFrame, gone: DataFrame, key: list[str] = KEY) -> DataFrame:
    return states.join(gone.select(*key), key, "left_anti")


def lookup(states: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the asked keys; an absent key gives none, a tombstone gives its row."""
    return states.join(keys, [c for c in KEY if c in keys.columns], "left_semi")


def mark_deleted(states: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Tombstones for ``gone`` (drive_id, path): clock of the drive one up, hash kept; unknown paths get a new row."""
    rows = gone.select(*KEY).distinct().join(states, KEY, "left")
    vector = vv.to_json(vv.increment(vv.parse(F.col("version_vector")), F.col("drive_id")))
    new = rows.select("drive_id", "path", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime", now).cast("long").alias("mtime"), vector.alias("version_vector"), F.lit(True).alias("tombstone"), F.coalesce("corrupted", F.lit(False)).alias("corrupted"), "inode")
    return merge(states, new)


def register_drives(drives: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert into the registry; ``seen`` has drive_id and last_seen."""
    return merge(drives, seen.groupBy("drive_id").agg(F.max("last_seen").alias("last_seen")), ["drive_id"])


def update_last_seen(drives: DataFrame, drive: str, now: int) -> DataFrame:
    """Sets the time of a known drive; an unknown one changes nothing."""
    return drives.withColumn("last_seen", F.when(F.col("drive_id") == drive, F.lit(now).cast("long")).otherwise(F.col("last_seen")))


def begin(log: DataFrame, ops: DataFrame, now: Column) -> DataFrame:
    """Appends an open row for each of ``ops`` (seq, operation, path): ids go on after the greatest of the log."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    new = ops.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("seq")).alias("id"), "operation", "path", now.cast("long").alias("timestamp"), F.lit(False).alias("completed"))
    return log.unionByName(new)


def node_hash(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored Merkle hashes of the asked (drive_id, path, level); an unknown node gives no row."""
    return nodes.join(keys.select(*KEY, "level"), [*KEY, "level"], "left_semi").select(*KEY, "level", "hash")


def complete(log: DataFrame, done: DataFrame) -> DataFrame:
    """Appends a completed row for each id of ``done``; ``latest`` reads the state."""
    return log.unionByName(log.join(done.select("id"), "id", "left_semi").withColumn("completed", F.lit(True)))


def latest(log: DataFrame) -> DataFrame:
    """One row an id, completed if any of its rows is."""
    order = Window.partitionBy("id").orderBy(F.col("completed").desc())
    return log.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def incomplete(log: DataFrame) -> DataFrame:
    """Open rows in the order of their ids."""
    return log.groupBy("id").agg(F.min("operation").alias("operation"), F.min("path").alias("path"), F.min("timestamp").alias("timestamp"), F.max("completed").alias("completed")).filter(~F.col("completed")).orderBy("id")


def with_retry(action: Callable[[], object], tries: int = 5, delay: float = 0.01, retry: tuple = (OSError,)) -> object:
    """Runs ``action`` again after a passing failure, waiting twice as long each time."""
    for left in reversed(range(tries)):
        try:
            return action()
        except retry:
            if not left:
                raise
            time.sleep(delay)
            delay *= 2
