"""Conflict detection and resolution over the versions of each path, one array per path and no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vv
from ..sources.manifest import merge

#: Strategies, in the order they are tried.
DOMINANT, QUORUM, TOMBSTONE, LAST_WRITE, COPY_ALL, MANUAL = "DOMINANT_VERSION", "MAJORITY_QUORUM", "TOMBSTONE_WINS", "LAST_WRITE_WINS", "COPY_ALL_VERSIONS", "MANUAL_RESOLUTION"
FIELDS = ["drive_id", "hash", "mtime", "version_vector", "tombstone"]


def by_path(states: DataFrame) -> DataFrame:
    """(path, vs): versions in the order of drive ids, each with its parsed vector ``m``. At most one a drive.

    Given its own result it passes that on, so callers with several steps group and parse once.
    """
    if "vs" in states.columns:
        return states
    rows = states.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("vs"))
    return rows.withColumn("vs", F.transform("vs", lambda v: F.struct(*[v[c].alias(c) for c in FIELDS], vv.parse(v["version_vector"]).alias("m"))))


def _conflicting(a: Column, b: Column) -> Column:
    """Concurrent, or one is live and dominates a tombstone."""
    revived = lambda x, y: vv.dominates(x["m"], y["m"]) & ~x["tombstone"] & y["tombstone"]
    return vv.concurrent(a["m"], b["m"]) | revived(a, b) | revived(b, a)


def conflicting_paths(states: DataFrame) -> DataFrame:
    vs = F.col("vs")
    pair = F.exists(vs, lambda a: F.exists(vs, lambda b: (a["drive_id"] < b["drive_id"]) & _conflicting(a, b)))
    return by_path(states).filter((F.size("vs") >= 2) & pair)


def detect(states: DataFrame) -> DataFrame:
    """(path, drives, n_versions, recommended_strategy) of every path with versions in conflict."""
    return conflicting_paths(states).select("path", F.array_join(F.transform("vs", lambda v: v["drive_id"]), ",").alias("drives"), F.size("vs").cast("long").alias("n_versions"), F.lit(MANUAL).alias("recommended_strategy"))


def resolve(states: DataFrame, drives: DataFrame, quorum_threshold: float | None = None) -> DataFrame:
    """(path, winner, strategy, actions). A quorum is more than half of all drives, or than the given share."""
    total = drives.agg(F.count("*").alias("total"))
    rows = conflicting_paths(states).crossJoin(F.broadcast(total))  # one row
    vs, n = F.col("vs"), F.col("total")
    agreeing = lambda v: F.size(F.filter(vs, lambda o: ~o["tombstone"] & (o["hash"] == v["hash"])))
    enough = lambda v: (agreeing(v) * 2 > n) if quorum_threshold is None else (agreeing(v) > n * quorum_threshold)
    pick = lambda found: F.try_element_at(found, F.lit(1))
    rows = rows.select(
        "path", "vs", "total",
        pick(F.filter(vs, lambda c: F.forall(vs, lambda o: vv.covers(c["m"], o["m"])))).alias("dominant"),
        pick(F.filter(vs, lambda c: ~c["tombstone"] & (n > 0) & enough(c))).alias("quorum"),
        pick(F.filter(vs, lambda c: c["tombstone"])).alias("tomb"),
        pick(F.filter(vs, lambda c: (c["mtime"] > 0) & (c["mtime"] == F.array_max(F.transform(vs, lambda o: o["mtime"]))))).alias("newest"),
    )
    got = lambda c: F.col(c).isNotNull()
    votes = F.size(F.filter("vs", lambda o: ~o["tombstone"] & (o["hash"] == F.col("quorum.hash"))))
    return rows.select(
        "path",
        F.coalesce(*[F.col(c)["drive_id"] for c in ("dominant", "quorum", "tomb", "newest")], F.lit("")).alias("winner"),
        F.when(got("dominant"), DOMINANT).when(got("quorum"), QUORUM).when(got("tomb"), TOMBSTONE).when(got("newest"), LAST_WRITE).otherwise(COPY_ALL).alias("strategy"),
        F.when(got("dominant"), F.concat(F.lit("Selected dominant version from drive "), F.col("dominant.drive_id")))
        .when(got("quorum"), F.concat(F.lit("Quorum: "), votes.cast("string"), F.lit("/"), n.cast("string"), F.lit(" drives agree on "), F.col("quorum.hash"), F.lit("; Version vectors merged to reflect resolution")))
        .when(got("tomb"), F.concat(F.lit("Tombstone from drive "), F.col("tomb.drive_id"), F.lit(" wins for "), F.col("path")))
        .when(got("newest"), F.concat(F.lit("Last-write-wins: drive "), F.col("newest.drive_id"), F.lit(" mtime="), F.col("newest.mtime").cast("string")))
        .otherwise(F.concat(F.lit("Preserving all versions of "), F.col("path"))).alias("actions"),
    )


def quorum_vote(states: DataFrame, drives: DataFrame) -> DataFrame:
    """(path, hash, votes, first_drive): the content on more than half of all drives."""
    total = F.broadcast(drives.agg(F.count("*").alias("total")))
    votes = states.filter(~F.col("tombstone")).groupBy("path", "hash").agg(F.count("*").alias("votes"), F.min("drive_id").alias("first_drive"))
    return votes.crossJoin(total).filter(F.col("votes") * 2 > F.col("total")).drop("total")


def last_write(states: DataFrame) -> DataFrame:
    """(path, winner, mtime): greatest time above 0, the first drive on a tie."""
    ranked = states.filter("mtime > 0")
    top = ranked.groupBy("path").agg(F.max("mtime").alias("mtime"))
    return ranked.join(top, ["path", "mtime"]).groupBy("path", "mtime").agg(F.min("drive_id").alias("winner")).select("path", "winner", "mtime")


def resolve_manually(states: DataFrame, drives: DataFrame, choices: DataFrame) -> DataFrame:
    """The next states after ``choices`` (path, winner): the winner's row on every drive, with all vectors merged and
    the winner's clock one up. A choice whose winner lacks the path changes nothing."""
    vectors = by_path(states).select("path", vv.merge_all(F.transform("vs", lambda v: v["m"])).alias("m"))
    won = states.join(choices.select("path", F.col("winner").alias("drive_id")), ["drive_id", "path"]).select(*states.columns)
    won = won.join(vectors, "path").withColumn("version_vector", vv.to_json(vv.increment(F.col("m"), F.col("drive_id")))).drop("m", "drive_id")
    new = won.crossJoin(F.broadcast(drives.select("drive_id")))  # the registry: one row a drive
    return merge(states, new)
