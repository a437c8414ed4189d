"""The reconciliation plan: renames, removals, copies, replacements and directories, ordered and deduplicated.

Every path is decided in one row that holds its versions (at most one a drive), so targets come from an array and not
from a join. The order follows from a key: an operation comes after the directories above it, and otherwise in the
order of emission (renames by target and old path, then paths and targets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import vectors as vv
from ..storage import Scratch
from .conflicts import by_path

OPS = ["type", "source_drive", "target_drive", "path", "new_path", "version_vector"]
LAST = 1 << 30


def _targets(drives: DataFrame) -> DataFrame:
    """One row with the sorted drive ids; its size is the registry's."""
    return F.broadcast(drives.agg(F.array_sort(F.collect_set("drive_id")).alias("targets")))


def _at(vs: Column, drive: Column) -> Column:
    return F.try_element_at(F.filter(vs, lambda v: v["drive_id"] == drive), F.lit(1))


def renames(states: DataFrame, drives: DataFrame) -> DataFrame:
    """(target_drive, old_path, new_path): the target still has the old name live, another drive has it as a tombstone
    and the same content live under a name that the target lacks. The greatest source drive, then the greatest name.

    Content is matched through one row for each (source, target, hash), so copies of one content never multiply.
    """
    versions = by_path(states).crossJoin(_targets(drives))
    live = F.filter("vs", lambda v: ~v["tombstone"])
    pairs = F.flatten(F.transform(live, lambda s: F.transform(F.filter("targets", lambda t: (t != s["drive_id"]) & ~F.exists(live, lambda o: o["drive_id"] == t)), lambda t: F.struct(s["drive_id"].alias("source"), t.alias("target"), s["hash"].alias("hash")))))
    fresh = versions.select("path", F.explode(pairs).alias("p")).groupBy("p.source", "p.target", "p.hash").agg(F.max("path").alias("new_path"))
    dead = F.filter("vs", lambda v: v["tombstone"])
    olds = F.flatten(F.transform(live, lambda t: F.transform(F.filter(dead, lambda s: s["drive_id"] != t["drive_id"]), lambda s: F.struct(s["drive_id"].alias("source"), t["drive_id"].alias("target"), t["hash"].alias("hash")))))
    old = versions.select(F.col("path").alias("old_path"), F.explode(olds).alias("p")).select("old_path", "p.*")
    found = old.join(fresh, ["source", "target", "hash"])
    return found.groupBy(F.col("target").alias("target_drive"), "old_path").agg(F.max_by("new_path", "source").alias("new_path"))


def rename_ops(states: DataFrame, drives: DataFrame) -> DataFrame:
    """Renames as operations: from the first other drive that has the new name, with all vectors of both names."""
    versions = by_path(states)
    named = lambda name, alias: versions.select(F.col("path").alias(name), F.col("vs").alias(alias))
    rows = renames(states, drives).join(named("old_path", "olds"), "old_path").join(named("new_path", "news"), "new_path")
    source = F.try_element_at(F.filter("news", lambda v: ~v["tombstone"] & (v["drive_id"] != F.col("target_drive"))), F.lit(1))
    merged = vv.merge_all(F.transform(F.concat("olds", "news"), lambda v: v["m"]))
    return rows.select(F.lit("RENAME").alias("type"), source["drive_id"].alias("source_drive"), "target_drive", F.col("old_path").alias("path"), "new_path", vv.to_json(merged).alias("version_vector")).filter("source_drive is not null")


def dominant(vs: Column) -> Column:
    """The first version, replaced by each later one that dominates the one held so far."""
    return F.aggregate(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0))), vs[0], lambda held, v: F.when(vv.dominates(v["m"], held["m"]), v).otherwise(held))


def tombstone_quorum(states: DataFrame, drives: DataFrame) -> DataFrame:
    """(path, n_tombstones) of paths that are tombstones on more than half of all drives."""
    total = F.broadcast(drives.agg(F.count("*").alias("total")))
    dead = states.filter("tombstone").groupBy("path").agg(F.count("*").alias("n_tombstones"))
    return dead.crossJoin(total).filter(F.col("n_tombstones") * 2 > F.col("total")).drop("total")


def dominant_source(states: DataFrame) -> DataFrame:
    """(path, source_drive, merged): the dominance fold and the merged vector of each path."""
    rows = by_path(states)
    return rows.select("path", dominant(F.col("vs"))["drive_id"].alias("source_drive"), vv.to_json(vv.merge_all(F.transform("vs", lambda v: v["m"]))).alias("merged"))


def file_ops(states: DataFrame, drives: DataFrame, resolutions: DataFrame, scope: str = "reference") -> DataFrame:
    """Operations of every path, before renames are taken out.

    ``resolutions`` has (path, winner). With scope ``reference`` the winners apply to any path that they hold
    concurrently with another drive, in the order of the paths they were decided for; with ``path`` only to their own.
    """
    rows = by_path(states).crossJoin(_targets(drives))
    won = resolutions.filter("winner <> ''")
    if scope == "reference":
        first = won.groupBy("winner").agg(F.min("path").alias("p"))  # one row a drive
        order = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "winner"))), lambda w: w["winner"]).alias("winners"))
        rows = rows.crossJoin(F.broadcast(order))
    elif scope == "path":
        rows = rows.join(won.select("path", F.array("winner").alias("winners")), "path", "left").withColumn("winners", F.coalesce("winners", F.array().cast("array<string>")))
    else:
        raise ValueError(f"unknown scope {scope}")
    vs = F.col("vs")
    applies = lambda w: F.exists(vs, lambda a: (a["drive_id"] == w) & F.exists(vs, lambda b: (b["drive_id"] != w) & vv.concurrent(a["m"], b["m"])))
    rows = rows.withColumn("winner", F.try_element_at(F.filter("winners", applies), F.lit(1)))
    rows = rows.withColumn("src", F.when(F.col("winner").isNotNull(), _at(vs, F.col("winner"))).otherwise(dominant(vs)))
    rows = rows.withColumn("dead", F.filter("vs", lambda v: v["tombstone"]))
    vectors = lambda c: vv.to_json(vv.merge_all(F.transform(c, lambda v: v["m"])))
    rows = rows.withColumn("quorum", F.size("dead") * 2 > F.size("targets")).withColumn("vector", F.when(F.col("quorum"), vectors("dead")).otherwise(vectors("vs")))
    rows = rows.withColumn("source", F.when(F.col("quorum"), F.try_element_at("dead", F.lit(1))["drive_id"]).otherwise(F.col("src.drive_id")))

    def decide(target: Column) -> Column:
        held = _at(vs, target)
        alive = F.coalesce(~held["tombstone"], F.lit(False))
        src = F.col("src")
        plain = F.when(target == src["drive_id"], F.lit(None)).when(src["tombstone"], F.when(alive, "REMOVE")).when(~alive, "COPY").when(vv.dominates(src["m"], held["m"]) | (src["hash"] != held["hash"]), "REPLACE")
        return F.struct(target.alias("target"), F.when(F.col("quorum"), F.when(alive, "REMOVE")).otherwise(plain).alias("type"))

    found = rows.select("path", "source", "vector", F.explode(F.filter(F.transform("targets", decide), lambda t: t["type"].isNotNull())).alias("t"))
    return found.select(F.col("t.type").alias("type"), F.col("source").alias("source_drive"), F.col("t.target").alias("target_drive"), "path", F.lit(None).cast("string").alias("new_path"), F.col("vector").alias("version_vector"))


def operations(states: DataFrame, drives: DataFrame, resolutions: DataFrame, scope: str = "reference") -> DataFrame:
    """Renames and file operations without directories and order; (target, path) of a rename is spared the rest.

    Versions are grouped by path once and written, as renames and file operations read them several times.
    """
    if "vs" not in states.columns:
        states, _ = Scratch(states.sparkSession).write(by_path(states))
    moved = rename_ops(states, drives)
    handled = moved.select("target_drive", F.explode(F.array("path", "new_path")).alias("path"))
    return moved.unionByName(file_ops(states, drives, resolutions, scope).join(handled, ["target_drive", "path"], "left_anti").select(*OPS))


def _keyed(ops: DataFrame) -> DataFrame:
    rename = F.col("type") == "RENAME"
    key = F.struct(F.when(rename, 0).otherwise(1).alias("phase"), F.when(rename, F.col("target_drive")).otherwise(F.col("path")).alias("k1"), F.when(rename, F.col("path")).otherwise(F.col("target_drive")).alias("k2"), F.lit(LAST).alias("sub"))
    return ops.withColumn("key", key)


def mkdirs(ops: DataFrame) -> DataFrame:
    """MKDIR rows with their keys: every directory above a copied or renamed path, once a target, before the first
    operation that needs it, deepest first."""
    needs = _keyed(ops.filter(F.col("type").isin("COPY", "RENAME")))
    dirs = needs.select("target_drive", "key", F.posexplode(paths.ancestor_dirs(F.coalesce("new_path", "path"))).alias("sub", "dir"))
    first = dirs.groupBy("target_drive", "dir").agg(F.min(F.struct(F.col("key.phase").alias("phase"), F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"), F.col("sub").alias("sub"))).alias("key"))
    return first.select(F.lit("MKDIR").alias("type"), F.lit("").alias("source_drive"), "target_drive", F.col("dir").alias("path"), F.lit(None).cast("string").alias("new_path"), F.lit("{}").alias("version_vector"), "key")


def order(ops: DataFrame) -> DataFrame:
    """(seq, ...) of all operations with their directories, the last one of each (target, path) kept.

    The rows are dealt into ranges of the order and written once; ranks are a range's offset plus a rank inside it.
    """
    scratch = Scratch(ops.sparkSession)
    ops, _ = scratch.write(ops)
    dirs = mkdirs(ops)
    rows = _keyed(ops).unionByName(dirs)
    above = rows.select("target_drive", "path").distinct().select("target_drive", "path", F.posexplode(paths.ancestor_dirs(F.col("path"))).alias("up", "dir"))
    chains = above.join(dirs.select("target_drive", F.col("path").alias("dir"), F.col("key").alias("dkey")), ["target_drive", "dir"])
    chains = chains.groupBy("target_drive", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("up"), "dkey"))), lambda x: x["dkey"]).alias("chain"))
    rows = rows.join(chains, ["target_drive", "path"], "left")
    rows = rows.withColumn("rank", F.struct(F.coalesce(F.size("chain"), F.lit(0)).alias("n"), F.coalesce("chain", F.array().cast(chains.schema["chain"].dataType)).alias("chain"), "key"))
    keep = Window.partitionBy("target_drive", "path").orderBy(F.col("rank").desc())
    rows = rows.withColumn("_r", F.row_number().over(keep)).filter("_r = 1").drop("_r", "chain", "key")
    dealt, _ = scratch.write(rows.repartitionByRange("rank").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("rank"))
    return dealt.withColumn("_r", inside).join(F.broadcast(before), "part").select((F.col("before") + F.col("_r")).alias("seq"), *OPS)


def plan(states: DataFrame, drives: DataFrame, resolutions: DataFrame, scope: str = "reference") -> DataFrame:
    return order(operations(states, drives, resolutions, scope))


def summary(ops: DataFrame, states: DataFrame) -> DataFrame:
    """(type, n_ops, total_bytes): bytes are the source sizes of copies and replacements."""
    moved = states.select(F.col("drive_id").alias("source_drive"), "path", "size")
    sized = ops.join(moved, ["source_drive", "path"], "left")
    return sized.groupBy("type").agg(F.count("*").alias("n_ops"), F.coalesce(F.sum(F.when(F.col("type").isin("COPY", "REPLACE"), F.col("size"))), F.lit(0)).alias("total_bytes"))
