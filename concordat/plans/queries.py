"""Every operator as a named query over the derived manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import vectors as vv
from ..operators import bloom, chunking, conflicts, effects, merkle, planner, scan
from ..sources import manifest
from ..storage import Scratch
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}

CHUNK_SIZES = {"least": 256, "average": 1024, "most": 4096, "threshold": 1024}
BLOOM_RATE = 0.01
NOW = 1_800_000_000


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def _written(df: DataFrame) -> DataFrame:
    return Scratch(df.sparkSession).write(df)[0]


def _pairs(s, d) -> DataFrame:
    rows = fx.states(s, d).select("path", "drive_id", vv.parse(F.col("version_vector")).alias("m"))
    other = rows.select("path", F.col("drive_id").alias("other"), F.col("m").alias("n"))
    return rows.join(other, "path")


@query
def drive_status(s, d):
    return scan.status(fx.states(s, d), fx.drives(s))


@query
def drive_register(s, d):
    seen = s.createDataFrame([("drive_b", NOW), ("drive_z", NOW)], manifest.DRIVES)
    return manifest.update_last_seen(manifest.register_drives(fx.drives(s), seen), "drive_c", NOW + 1)


@query
def manifest_lookup(s, d):
    docs = fx.documents(s, d)
    absent = docs.select(F.concat("path", F.lit(".absent")).alias("path"))
    return manifest.lookup(fx.states(s, d), docs.select("path").unionByName(absent))


@query
def manifest_upsert(s, d):
    states = fx.states(s, d)
    new = states.filter("drive_id = 'drive_a'").withColumn("mtime", F.col("mtime") + 1).withColumn("drive_id", F.lit("drive_b"))
    return manifest.merge(states, new)


@query
def vv_compare(s, d):
    return _pairs(s, d).select("path", "drive_id", "other", vv.compare(F.col("m"), F.col("n")).alias("ordering"))


@query
def vv_merge(s, d):
    return _pairs(s, d).select("path", "drive_id", "other", vv.to_json(vv.merge(F.col("m"), F.col("n"))).alias("merged"))


@query
def vv_increment(s, d):
    m = vv.parse(F.col("version_vector"))
    return fx.states(s, d).select("path", "drive_id", vv.to_json(vv.increment(m, F.col("drive_id"))).alias("next"), vv.clock(m, F.col("drive_id")).alias("clock"))


@query
def vv_canonical_json(s, d):
    swapped = F.concat(F.lit('{"z\\"k\\\\":3, '), F.substring("version_vector", F.lit(2), F.char_length("version_vector")))
    text = F.when(F.col("version_vector") == "{}", F.col("version_vector")).otherwise(swapped)
    return fx.states(s, d).select("path", "drive_id", vv.to_json(vv.parse(text)).alias("canonical"))


@query
def vv_malformed(s, d):
    """Each state's vector as it is and in damaged forms."""
    damaged = [F.col("version_vector"), F.substring("version_vector", F.lit(1), F.char_length("version_vector") - 1), F.replace("version_vector", F.lit(":"), F.lit(":-")), F.replace("version_vector", F.lit(":"), F.lit(':"x",')), F.concat(F.lit("["), F.col("version_vector"), F.lit("]"))]
    rows = fx.states(s, d).select("drive_id", "path", F.posexplode(F.array(*damaged)).alias("form", "text"))
    return rows.select("drive_id", "path", "form", vv.malformed(F.col("text")).alias("malformed"))


@query
def detect_conflicts(s, d):
    return conflicts.detect(fx.states(s, d))


@query
def resolve_conflicts(s, d):
    return conflicts.resolve(fx.states(s, d), fx.drives(s))


@query
def quorum_vote(s, d):
    return conflicts.quorum_vote(fx.states(s, d), fx.drives(s))


@query
def last_write_wins(s, d):
    return conflicts.last_write(fx.states(s, d))


@query
def manual_resolve(s, d):
    states = fx.states(s, d)
    choices = conflicts.detect(states).select("path", F.lit("drive_b").alias("winner"))
    return conflicts.resolve_manually(states, fx.drives(s), choices)


@query
def hidden_filter(s, d):
    return scan.visible(fx.listing(s, d)).select("drive_id", "path", "size", "mtime")


@query
def hash_cache(s, d):
    return scan.hashed(fx.listing(s, d), fx.states(s, d), F.col("content_hash"))


@query
def scan_manifest(s, d):
    return scan.scan(fx.listing(s, d), fx.states(s, d), F.lit(NOW), F.col("content_hash"))


@query
def tombstone_vanished(s, d):
    states = fx.states(s, d)
    gone = scan.vanished(fx.listing(s, d), states.filter("drive_id = 'drive_b'"))
    return manifest.mark_deleted(states, gone, F.lit(NOW)).join(gone.select(*manifest.KEY), manifest.KEY, "left_semi")


@query
def scan_errors(s, d):
    listing = fx.listing(s, d)
    failed = F.when(F.col("size") % 7 == 0, F.concat(F.lit("hash: cannot read "), F.col("path")))
    return scan.errors_of(scan.visible(listing), failed)


@query
def path_normalize(s, d):
    raw = F.concat(F.translate("path", "/", "\\"), F.when(F.col("doc_id") % 2 == 0, "//").otherwise(""))
    return fx.documents(s, d).select("doc_id", paths.normalize(raw).alias("path"), paths.parent_dir(F.col("path")).alias("parent"), paths.hidden(F.concat(F.lit("a/.b/"), F.col("path"))).alias("hidden"))


@query
def ancestor_dirs(s, d):
    return fx.documents(s, d).select("doc_id", F.posexplode(paths.ancestor_dirs(F.col("path"))).alias("up", "dir"))


@query
def perm_octal(s, d):
    mode = F.lpad((F.col("doc_id") % 1000).cast("string"), 4, "0")
    flags = paths.permissions_flags(mode)
    return fx.documents(s, d).select("doc_id", paths.permissions_text(flags).alias("mode"), flags["owner_write"].alias("owner_write"), flags["others_exec"].alias("others_exec"))


@query
def drive_id_clean(s, d):
    return fx.table(s, d, "documents").select("doc_id", paths.drive_id(F.concat(F.lit("/mnt/"), F.col("source"), F.lit("-x_"))).alias("drive"), paths.drive_id(F.lit("--")).alias("fallback"))


@query
def format_size(s, d):
    return fx.documents(s, d).select("doc_id", paths.format_bytes(F.col("size") * (F.lit(1024) ** (F.col("doc_id") % 3)).cast("long") * 4).alias("shown"))


@query
def merkle_nodes(s, d):
    return merkle.nodes(fx.states(s, d).filter("not tombstone").select("drive_id", "path", "hash"))


@query
def merkle_diff(s, d):
    nodes = _written(merkle.nodes(fx.states(s, d).filter("not tombstone").select("drive_id", "path", "hash")))
    return merkle.diff(nodes.filter("drive_id = 'drive_b'"), nodes.filter("drive_id = 'drive_c'"))


@query
def detect_renames(s, d):
    return planner.renames(fx.states(s, d), fx.drives(s))


@query
def tombstone_quorum(s, d):
    return planner.tombstone_quorum(fx.states(s, d), fx.drives(s))


@query
def dominant_source(s, d):
    return planner.dominant_source(fx.states(s, d))


def _resolutions(states, drives):
    return conflicts.resolve(states, drives).select("path", "winner")


def _versions(s, d, states=None) -> DataFrame:
    return _written(conflicts.by_path(fx.states(s, d) if states is None else states))


def _operations(s, d, states=None, scope="reference") -> DataFrame:
    versions = _versions(s, d, states)
    return planner.operations(versions, fx.drives(s), _resolutions(versions, fx.drives(s)), scope)


def _plan(s, d, states=None, scope="reference") -> DataFrame:
    return planner.order(_operations(s, d, states, scope))


@query
def plan_ops(s, d):
    return _operations(s, d)


@query
def plan_ops_path_scope(s, d):
    return _operations(s, d, scope="path")


@query
def plan_mkdirs(s, d):
    return planner.mkdirs(_written(plan_ops(s, d))).select("target_drive", "path")


@query
def sync_plan(s, d):
    return _plan(s, d)


@query
def plan_summary(s, d):
    return planner.summary(_plan(s, d), fx.states(s, d))


@query
def apply_plan(s, d):
    return effects.apply(_written(_operations(s, d)), fx.states(s, d))


@query
def replan_after_apply(s, d):
    after = _written(apply_plan(s, d))
    return _plan(s, d, after).groupBy("type").agg(F.count("*").alias("n_ops"))


@query
def verify_files(s, d):
    return scan.verify(fx.states(s, d), fx.disk(s, d))


@query
def corrupt_count(s, d):
    return scan.verify(fx.states(s, d), fx.disk(s, d)).groupBy("drive_id").agg(F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("n_corrupt"))


@query
def restore_candidates(s, d):
    states, disk = fx.states(s, d), fx.disk(s, d)
    return scan.replicas(states, disk, scan.verify(states, disk).filter("not ok"))


@query
def incomplete_ops(s, d):
    return manifest.incomplete(fx.log(s, d))


@query
def recover_log(s, d):
    return effects.recover(fx.log(s, d), fx.temps(s, d), fx.log_states(s, d))


def _chunks(s, d, content):
    return chunking.chunk(fx.table(s, d, "documents"), "doc_id", content, **CHUNK_SIZES)


@query
def chunk_documents(s, d):
    return _chunks(s, d, F.col("text")).withColumnRenamed("id", "doc_id")


@query
def chunk_pages(s, d):
    return chunking.chunk(fx.table(s, d, "pages"), "page_id", F.col("html")).withColumnRenamed("id", "page_id")


@query
def chunk_diff(s, d):
    edited = F.overlay("text", F.lit("#### an edit ####"), F.lit(400))
    return chunking.delta(_chunks(s, d, F.col("text")), _chunks(s, d, edited)).withColumnRenamed("id", "doc_id")


@query
def bloom_sizing(s, d):
    rows = [(n, p, *bloom.sizing(n, p)) for n in (0, 1, 500, 1000, 1_000_000) for p in (0.001, 0.01, 0.05)]
    return s.createDataFrame([(n, p, m, k, bloom.size_bytes(m)) for n, p, m, k in rows], "items bigint, rate double, bits bigint, hashes bigint, bytes bigint")


@query
def bloom_membership(s, d):
    states = fx.states(s, d)
    items = states.filter("drive_id = 'drive_c'").select("path")
    bits, count = bloom.sizing(items.count(), BLOOM_RATE)
    return bloom.might_contain(bloom.insert(items, "path", bits, count), states.select("path").distinct(), "path", bits, count)


def bloom_bits(s, d):
    """The sizes that bloom_membership uses."""
    return bloom.sizing(fx.states(s, d).filter("drive_id = 'drive_c'").count(), BLOOM_RATE)
