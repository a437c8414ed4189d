"""Connected components by alternating large-star and small-star rounds, on long node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def _written(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, str, tuple]:
    """The edges, their path, and (count, checksum)."""
    held, path, seen = scratch.measured(edges, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    return held, path, (seen["n"], seen["s"])


def connected(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Each round relinks neighbours to the smallest one they know, so depths shrink at least by half; the edge list
    never grows. A round is written to the shared folder, which cuts the lineage; its predecessor is deleted. Rounds
    go on until one changes nothing.
    """
    edges, last, state = _written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), scratch)
    while state[0]:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        edges, path, now = _written(small, scratch)
        scratch.drop(last)
        if now == state:
            break
        last, state = path, now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
