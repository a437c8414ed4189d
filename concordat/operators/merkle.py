"""Merkle roll-up of a flat listing, and the difference of two trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import Scratch

ROOT = "."


def nodes(leaves: DataFrame) -> DataFrame:
    """(drive_id, path, level, hash) of leaves (drive_id, path, hash): files are level 0, directories level 1.

    A directory's hash is the SHA-256 of its children's hashes, sorted and put together; names are not in it. The
    roll-up takes one aggregation a depth, from the deepest directories to the root; each is written out.
    """
    scratch = Scratch(leaves.sparkSession)
    rows = leaves.filter("hash <> ''").select("drive_id", "path", F.lit(0).alias("level"), "hash", F.size(F.split("path", "/")).alias("depth"))
    rows, _ = scratch.write(rows)
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    made: list[DataFrame] = [rows]
    above: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        children = rows.filter(F.col("depth") == depth)
        if above is not None:
            children = children.unionByName(above)
        parent = F.when(F.lit(depth == 1), F.lit(ROOT)).otherwise(paths.parent_dir(F.col("path")))
        found = children.groupBy("drive_id", parent.alias("path")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("hash"))
        above, _ = scratch.write(found.select("drive_id", "path", F.lit(1).alias("level"), "hash", F.lit(depth - 1).alias("depth")))
        made.append(above)
    return reduce(DataFrame.unionByName, made).drop("depth")


def diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """(path, change) between the node tables of two trees: added, modified or deleted leaves.

    Nothing is reported below a directory with the same hash in both trees, so a rename inside a directory does not
    show. Where a path is a file in one tree and a directory in the other, only the directory's leaves are reported.
    """
    leaf = lambda t, name: t.filter("level = 0").select("path", F.col("hash").alias(name))
    folder = lambda t, name: t.filter("level = 1").select(F.col("path"), F.col("hash").alias(name))
    rows = leaf(one, "h1").join(leaf(two, "h2"), "path", "full").filter(~F.col("h1").eqNullSafe(F.col("h2")))
    folders = folder(one, "d1").join(folder(two, "d2"), "path", "full")
    rows = rows.join(folders.select(F.col("path"), F.lit(True).alias("is_dir")), "path", "left").filter("is_dir is null").drop("is_dir")
    same = folders.filter("d1 = d2").select(F.col("path").alias("dir"))
    above = rows.select("path", F.explode(F.concat(paths.ancestor_dirs(F.col("path")), F.array(F.lit(ROOT)))).alias("dir"))
    pruned = above.join(same, "dir", "left_semi").select("path").distinct()
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "deleted").otherwise("modified")
    return rows.join(pruned, "path", "left_anti").select("path", change.alias("change"))
