"""Effects of a plan on the manifests and on the files, and recovery of unfinished writes."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.manifest import KEY, delete, incomplete, merge
from .scan import digest_file

TEMPORARY = ".concordat.tmp"
#: Operations of one phase do not touch each other's files; a phase ends before the next one begins.
PHASES = (("MKDIR",), ("RENAME",), ("COPY", "REPLACE"), ("REMOVE",))


def atomic_copy(source: str, target: str, wanted: str) -> int:
    """Copies a file with its mode and times under a temporary name, checks the hash before and after, and renames it.
    Nothing of a failed copy stays. A task that runs again makes the same file again. Gives the bytes."""
    if digest_file(source) != wanted:
        raise OSError("source differs from its manifest")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}{TEMPORARY}.{os.getpid()}"
    try:
        shutil.copy2(source, part)
        if digest_file(part) != wanted:
            raise OSError("copy differs from its source")
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return os.path.getsize(target)


def _perform(kind: str, source: str, target: str, new: str, wanted: str | None) -> int:
    if kind == "MKDIR":
        os.makedirs(target, exist_ok=True)
    elif kind == "RENAME":
        if os.path.exists(target) or not os.path.exists(new):  # else an earlier try has moved it
            os.makedirs(os.path.dirname(new), exist_ok=True)
            os.replace(target, new)
    elif kind == "REMOVE":
        if os.path.exists(target):
            os.remove(target)
    else:
        return atomic_copy(source, target, wanted or "")
    return 0


def transfer(ops: DataFrame, states: DataFrame, roots: dict[str, str], kinds: tuple[str, ...]) -> DataFrame:
    """(seq, ok, message, bytes): the operations of ``kinds`` done on the files, one a row, by the tasks.

    ``roots`` names the folder of every drive, mounted on every executor. A failure is a row and stops no other.
    Reading the result twice does the work twice, with the same outcome: write it.
    """
    hashes = states.select(F.col("drive_id").alias("source_drive"), "path", "hash")
    rows = ops.filter(F.col("type").isin(*kinds)).join(hashes, ["source_drive", "path"], "left").select("seq", "type", "source_drive", "target_drive", "path", "new_path", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                at = lambda drive, path: os.path.join(roots[drive], path) if drive in roots and path else ""
                try:
                    if r["target_drive"] not in roots or r["type"] in PHASES[2] and r["source_drive"] not in roots:
                        raise OSError("unknown drive")
                    size = _perform(r["type"], at(r["source_drive"], r["path"]), at(r["target_drive"], r["path"]), at(r["target_drive"], r["new_path"]), r["hash"])
                    done.append((r["seq"], True, "", size))
                except OSError as error:
                    done.append((r["seq"], False, str(error.strerror or error), 0))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.int64()))], ["seq", "ok", "message", "bytes"])

    return rows.mapInArrow(run, "seq long, ok boolean, message string, bytes long")


def apply(ops: DataFrame, states: DataFrame, sync_source: bool = False) -> DataFrame:
    """The next states. COPY and REPLACE put the source's row on the target with the planned vector, REMOVE makes a
    tombstone and keeps the rest of the row, RENAME moves the target's row and leaves nothing at the old path. With
    ``sync_source`` the source of a copy or replacement gets the planned vector too, which saves a later round."""
    columns = states.columns
    rest = [c for c in columns if c not in KEY + ["version_vector"]]
    source = states.select(F.col("drive_id").alias("source_drive"), "path", *rest)
    copied = ops.filter(F.col("type").isin("COPY", "REPLACE")).join(source, ["source_drive", "path"]).select(F.col("target_drive").alias("drive_id"), "path", "version_vector", *rest)
    own = states.select(F.col("drive_id").alias("target_drive"), "path", *rest)
    gone = ops.filter("type = 'REMOVE'").join(own, ["target_drive", "path"]).withColumn("tombstone", F.lit(True)).select(F.col("target_drive").alias("drive_id"), "path", "version_vector", *rest)
    moves = ops.filter("type = 'RENAME'").join(own, ["target_drive", "path"])
    moved = moves.select(F.col("target_drive").alias("drive_id"), F.col("new_path").alias("path"), "version_vector", *rest)
    new = copied.unionByName(gone).unionByName(moved)
    if sync_source:
        told = ops.filter(F.col("type").isin("COPY", "REPLACE")).groupBy(F.col("source_drive").alias("drive_id"), "path").agg(F.max("version_vector").alias("version_vector"))
        told = told.join(states.drop("version_vector"), KEY).join(new.select(*KEY), KEY, "left_anti")
        new = new.unionByName(told.select(*new.columns))
    return merge(delete(states, moves.select(F.col("target_drive").alias("drive_id"), "path")), new)


def failures(ops: DataFrame, states: DataFrame, drives: DataFrame) -> DataFrame:
    """(target_drive, path, reason) of operations that cannot run: unknown drive, or no source row."""
    known = drives.select("drive_id").withColumn("known", F.lit(True))
    rows = ops.join(known.select(F.col("drive_id").alias("target_drive"), F.col("known").alias("kt")), "target_drive", "left")
    source = states.select(F.col("drive_id").alias("source_drive"), "path", F.lit(True).alias("ks"))
    rows = rows.join(source, ["source_drive", "path"], "left")
    needs = F.col("type").isin("COPY", "REPLACE")
    reason = F.when(F.col("kt").isNull(), "unknown drive").when(needs & F.col("ks").isNull(), "source file not in manifest")
    return rows.select("target_drive", "path", reason.alias("reason")).filter("reason is not null")


def recover(log: DataFrame, temps: DataFrame, states: DataFrame) -> DataFrame:
    """(id, path, decision) of open log entries: a WRITE with a temporary file is promoted if that file's hash
    (``temps``: path, tmp_hash) is the manifest's, else discarded; anything else needs nothing. All get closed."""
    rows = incomplete(log).join(temps, "path", "left").join(states.select("path", "hash"), "path", "left")
    decision = F.when((F.col("operation") != "WRITE") | F.col("tmp_hash").isNull(), "NONE").when(F.col("tmp_hash") == F.col("hash"), "PROMOTE").otherwise("DISCARD")
    return rows.select("id", "path", decision.alias("decision"))


def restore(states: DataFrame, replicas: DataFrame) -> DataFrame:
    """Clears the flag of rows that found a replica (drive_id, path, replica)."""
    healed = states.join(replicas.filter("replica is not null").select(*KEY), KEY, "left_semi").withColumn("corrupted", F.lit(False))
    return merge(states, healed)
