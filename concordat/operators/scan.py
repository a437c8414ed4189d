"""Directory scans against a manifest: hidden files, hash cache, write-back, tombstones, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import vectors as vv
from ..sources.manifest import KEY, mark_deleted, merge


def files(spark: SparkSession, root: str, drive: str) -> DataFrame:
    """Listing of a folder: (drive_id, path, size, mtime, uri, content), paths relative with forward slashes.

    ``content`` is read only by plans that use it, and then of every file; ``contents`` reads what it must.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    name = F.regexp_replace("path", "^(file:)?/*" + base.removeprefix("file:").strip("/") + "/+", "")
    return found.select(F.lit(drive).alias("drive_id"), name.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.col("path").alias("uri"), "content")


def local_path(uri: str) -> str:
    """A file's path on the machine; drives are folders that every executor has mounted."""
    if "://" in uri and not uri.startswith("file://"):
        raise OSError(f"not a mounted folder: {uri}")
    return "/" + uri.removeprefix("file:").lstrip("/")


def digest_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_hashes(listing: DataFrame) -> DataFrame:
    """(drive_id, path, actual, reason): files are read in the tasks, piece by piece and of any size. One that cannot
    be read has no hash but a reason, ``hash:`` and the error, and the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(2).to_pylist():
                try:
                    found.append((digest_file(local_path(uri)), None))
                except OSError as error:
                    found.append((None, f"hash: {error.strerror or error}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], ["drive_id", "path", "actual", "reason"])

    return listing.select(*KEY, "uri").mapInArrow(run, "drive_id string, path string, actual string, reason string")


def contents(listing: DataFrame, states: DataFrame) -> DataFrame:
    """(drive_id, path, size, mtime, content_hash, reason) of the visible files: the cached hash where size and time are
    unchanged, and of the others, and of no more files, the hash of what is read."""
    found = cached(visible(listing.select(*KEY, "size", "mtime", "uri")), states)
    hits = found.filter("cached_hash is not null").select(*KEY, "size", "mtime", F.col("cached_hash").alias("content_hash"), F.lit(None).cast("string").alias("reason"))
    misses = found.filter("cached_hash is null")
    read = misses.select(*KEY, "size", "mtime").join(read_hashes(misses), KEY)
    return hits.unionByName(read.select(*KEY, "size", "mtime", F.col("actual").alias("content_hash"), "reason"))


def visible(listing: DataFrame) -> DataFrame:
    return listing.filter(~paths.hidden(F.col("path")))


def cached(listing: DataFrame, states: DataFrame) -> DataFrame:
    """Adds ``cached_hash``: the manifest's hash where size and time are unchanged, else null."""
    known = states.select(*KEY, F.col("hash").alias("_hash"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    hit = (F.col("_hash") != "") & (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime"))
    return listing.join(known, KEY, "left").withColumn("cached_hash", F.when(hit, F.col("_hash"))).drop("_hash", "_size", "_mtime")


def hashed(listing: DataFrame, states: DataFrame, content_hash: Column | None = None) -> DataFrame:
    """(drive_id, path, size, mtime, hash, hit): contents are hashed only where the cache misses."""
    content_hash = F.sha2("content", 256) if content_hash is None else content_hash
    found = cached(visible(listing), states)
    return found.select(*KEY, "size", "mtime", F.when(F.col("cached_hash").isNotNull(), F.col("cached_hash")).otherwise(content_hash).alias("hash"), F.col("cached_hash").isNotNull().alias("hit"))


def scan(listing: DataFrame, states: DataFrame, now: Column, content_hash: Column | None = None, errors: DataFrame | None = None, parity: bool = False, bump_on_change: bool = False) -> DataFrame:
    """The next states of the scanned drives.

    A file keeps the vector, ``corrupted`` and inode of its row and is live again; a live row without a file becomes
    a tombstone. Paths in ``errors`` could not be read and stay as they are, unless ``parity`` asks for tombstones as
    well. ``bump_on_change`` advances the drive's clock for new and changed contents, which a scan normally does not.
    """
    seen = hashed(listing, states, content_hash)
    kept = states.select(*KEY, F.col("hash").alias("_hash"), "version_vector", "corrupted", "inode")
    vector = F.coalesce("version_vector", F.lit("{}"))
    if bump_on_change:
        vector = F.when(F.col("_hash").eqNullSafe(F.col("hash")), vector).otherwise(vv.to_json(vv.increment(vv.parse(vector), F.col("drive_id"))))
    new = seen.join(kept, KEY, "left").select(*KEY, "hash", "size", "mtime", vector.alias("version_vector"), F.lit(False).alias("tombstone"), F.coalesce("corrupted", F.lit(False)).alias("corrupted"), "inode")
    live = states.filter(~F.col("tombstone")).join(listing.select("drive_id").distinct(), "drive_id", "left_semi")
    gone = live.select(*KEY).join(seen.select(*KEY), KEY, "left_anti")
    if errors is not None and not parity:
        gone = gone.join(errors.select(*KEY), KEY, "left_anti")
    return merge(mark_deleted(states, gone, now), new)


def errors_of(listing: DataFrame, reason: Column) -> DataFrame:
    """Side output (drive_id, path, reason) where ``reason`` is not null; prefixed file_size:, hash: and so on."""
    return listing.select(*KEY, reason.alias("reason")).filter("reason is not null")


def vanished(listing: DataFrame, states: DataFrame) -> DataFrame:
    """Live rows without a visible file."""
    return states.filter(~F.col("tombstone")).join(visible(listing).select(*KEY), KEY, "left_anti")


def verify(states: DataFrame, disk: DataFrame, internal_dir: str = ".concordat") -> DataFrame:
    """(drive_id, path, ok, corrupted): live rows against ``disk`` (drive_id, path, actual). A missing file is not ok;
    files of the engine's own folder always are; the flag is set by a mismatch and never cleared."""
    rows = states.filter(~F.col("tombstone")).join(disk.select(*KEY, "actual"), KEY, "left")
    ok = F.coalesce(F.col("actual") == F.col("hash"), F.lit(False)) | (F.split("path", "/")[0] == internal_dir)
    return rows.select(*KEY, ok.alias("ok"), (F.col("corrupted") | ~ok).alias("corrupted"))


def replicas(states: DataFrame, disk: DataFrame, wanted: DataFrame) -> DataFrame:
    """(drive_id, path, replica): for each wanted (drive_id, path), the first other drive with an intact copy."""
    need = wanted.select(*KEY).join(states.select(*KEY, "hash"), KEY)
    copies = states.filter(~F.col("tombstone")).join(disk.select(*KEY, "actual"), KEY).filter("actual = hash").select(F.col("drive_id").alias("replica"), "path", "hash")
    found = need.join(copies, ["path", "hash"], "left").filter(F.col("replica").isNull() | (F.col("replica") != F.col("drive_id")))
    best = found.groupBy(*KEY).agg(F.min("replica").alias("replica"))
    return need.select(*KEY).join(best, KEY, "left")


def status(states: DataFrame, drives: DataFrame) -> DataFrame:
    """(drive_id, n_files, total_size) of live files, 0 for an empty drive."""
    sums = states.filter(~F.col("tombstone")).groupBy("drive_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    return drives.select("drive_id").join(sums, "drive_id", "left").select("drive_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_files"), F.coalesce("s", F.lit(0)).cast("long").alias("total_size"))
