"""Command line: scan, status, conflicts, resolve, verify, sync and config over a folder of manifest snapshots.

The store has ``states/<n>`` snapshots, and ``nodes/<n>`` and ``log/<n>`` beside; a command reads the newest and writes
the next. A drive is a folder given as ``id=path``, mounted on every executor. ``sync`` does the plan's operations on
the files, in tasks, and only those that succeed reach the manifests; ``--manifest-only`` leaves files alone.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import conflicts, effects, merkle, planner, scan
from .sources import config, manifest
from .storage import Scratch

#: How operations are shown.
SHOWN = {"REMOVE": "DELETE"}


class Store:
    """Snapshots of the states, the Merkle nodes and the operation log. One that a failure cut short has no
    ``_SUCCESS``, is never read, and gives way to the next: a write is seen whole or not at all."""

    SCHEMAS = {"states": manifest.STATES, "nodes": manifest.NODES, "log": manifest.LOG}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _number(self, kind: str) -> int:
        folder, fs = self._path(f"{self.root}/{kind}")
        names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [p.getName() for p in names if fs.exists(self._path(f"{p.toString()}/_SUCCESS")[0])]
        return max((int(n) for n in whole if n.isdigit()), default=-1)

    def get(self, kind: str) -> DataFrame:
        return manifest.read(self.spark, f"{self.root}/{kind}/{self._number(kind)}", self.SCHEMAS[kind])

    def put(self, rows: DataFrame, kind: str = "states") -> None:
        target = f"{self.root}/{kind}/{self._number(kind) + 1}"
        torn, fs = self._path(target)
        fs.delete(torn, True)  # without _SUCCESS, or it would be the newest
        manifest.write(rows, target)

    def states(self) -> DataFrame:
        return self.get("states")

    def rebuild(self) -> None:
        """Drops all snapshots; the drives have to be scanned again."""
        for kind in self.SCHEMAS:
            folder, fs = self._path(f"{self.root}/{kind}")
            fs.delete(folder, True)

    def drives(self) -> DataFrame:
        return self.states().groupBy("drive_id").agg(F.lit(int(time.time())).cast("long").alias("last_seen"))


def _targets(args: argparse.Namespace) -> dict[str, str]:
    return dict(d.split("=", 1) for d in args.drive or [])


def do_scan(spark, args) -> int:
    store, drives, failed = Store(spark, args.store), _targets(args), 0
    if not drives:
        print("name at least one --drive id=path", file=sys.stderr)
        return 1
    for drive, root in drives.items():
        # Written once: the states and the errors both read it.
        found, _ = Scratch(spark).write(scan.contents(scan.files(spark, root, drive), store.states()))
        errors = scan.errors_of(found, F.col("reason"))
        store.put(scan.scan(found.filter("reason is null").drop("reason"), store.states(), F.lit(int(time.time())), F.col("content_hash"), errors))
        failed += errors.count()
        errors.show(args.limit, truncate=False)
        live = store.states().filter((F.col("drive_id") == drive) & ~F.col("tombstone"))
        store.put(store.get("nodes").filter(F.col("drive_id") != drive).unionByName(merkle.nodes(live).select(*manifest.NODES.names)), "nodes")
        print(f"{drive}: {live.count()} files")
    return int(failed > 0)


def do_status(spark, args) -> int:
    store = Store(spark, args.store)
    for r in scan.status(store.states(), store.drives()).orderBy("drive_id").collect():  # one row a drive
        print(f"{r['drive_id']}: {r['n_files']} files, {r['total_size']} bytes")
    return 0


def do_conflicts(spark, args) -> int:
    found = conflicts.detect(Store(spark, args.store).states())
    found.orderBy("path").show(args.limit, truncate=False)
    print(f"{found.count()} conflicts")
    return 0


def do_resolve(spark, args) -> int:
    store = Store(spark, args.store)
    choice = spark.createDataFrame([(args.path, args.winner)], "path string, winner string")
    if store.states().filter((F.col("path") == args.path) & (F.col("drive_id") == args.winner)).isEmpty():
        print("no such drive or file", file=sys.stderr)
        return 1
    store.put(conflicts.resolve_manually(store.states(), store.drives(), choice))
    return 0


def do_verify(spark, args) -> int:
    store, bad = Store(spark, args.store), 0
    for drive, root in _targets(args).items():
        states = store.states().filter(F.col("drive_id") == drive)
        if states.isEmpty():
            print(f"{drive}: no manifest", file=sys.stderr)
            return 1
        checked, _ = Scratch(spark).write(scan.verify(states, scan.read_hashes(scan.files(spark, root, drive))))
        bad += checked.filter(~F.col("ok")).count()
        flags = checked.select("drive_id", "path", F.col("corrupted").alias("flag"))
        store.put(store.states().join(flags, manifest.KEY, "left").withColumn("corrupted", F.coalesce("flag", "corrupted")).drop("flag"))
    print(f"{bad} corrupt files")
    return int(bad > 0)


def do_sync(spark, args) -> int:
    store = Store(spark, args.store)
    states, drives = store.states(), store.drives()
    if drives.count() < 2:
        print("fewer than two drives: nothing to do")
        return 0
    won = conflicts.resolve(states, drives).select("path", "winner")
    plan = planner.plan(states, drives, won, args.scope)
    for r in planner.summary(plan, states).orderBy("type").collect():  # one row a type
        print(f"{SHOWN.get(r['type'], r['type'])}: {r['n_ops']} ({r['total_bytes']} bytes)")
    if args.verbose:
        plan.orderBy("seq").show(args.limit, truncate=False)
    if args.dry_run:
        return 0
    scratch = Scratch(spark)
    failed, _ = scratch.write(effects.failures(plan, states, drives))
    plan = plan.join(failed, ["target_drive", "path"], "left_anti")
    bad = failed.count()
    if not args.manifest_only:
        roots = {drive: scan.local_path(root) for drive, root in _targets(args).items()}
        missing = [r["drive_id"] for r in drives.select("drive_id").collect() if r["drive_id"] not in roots]  # one row a drive
        if missing:
            print(f"name the folders of {', '.join(missing)} by --drive id=path, or take --manifest-only", file=sys.stderr)
            return 1
        plan, _ = scratch.write(plan)
        write = F.when(F.col("type").isin(*effects.PHASES[2]), "WRITE").otherwise(F.col("type"))
        log, _ = scratch.write(manifest.begin(store.get("log"), plan.select("seq", write.alias("operation"), "path"), F.lit(int(time.time()))))
        store.put(log, "log")
        done = None
        for kinds in effects.PHASES:
            part, _ = scratch.write(effects.transfer(plan, states, roots, kinds))
            done = part if done is None else done.unionByName(part)
        failed = done.filter("not ok")
        failed.join(plan, "seq").select("type", "target_drive", "path", "message").show(args.limit, truncate=False)
        print(f"{done.agg(F.coalesce(F.sum('bytes'), F.lit(0))).first()[0]} bytes copied")
        bad += failed.count()
        plan = plan.join(failed.select("seq"), "seq", "left_anti")
    store.put(effects.apply(plan, states))
    if not args.manifest_only:  # failed entries are closed as well: nothing of them is left on the target
        store.put(manifest.complete(log, manifest.incomplete(log)), "log")
    return int(bad > 0)


def do_config(spark, args) -> int:
    held = config.load(args.file)
    for item in args.set or []:
        key, mark, value = item.partition("=")
        if not mark:
            print(f"not key=value: {item}", file=sys.stderr)
            return 1
        held.set(key, value)
        print(f"Set {key}")
    held.save(args.file)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="concordat", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, run in (("scan", do_scan), ("status", do_status), ("conflicts", do_conflicts), ("resolve", do_resolve), ("verify", do_verify), ("sync", do_sync), ("config", do_config)):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        if name != "config":
            sub.add_argument("--store", required=True)
            sub.add_argument("--drive", action="append", help="id=path")
            sub.add_argument("--limit", type=int, default=50, help="rows shown")
        else:
            sub.add_argument("--file", default="concordat.conf")
            sub.add_argument("--set", action="append")
        if name == "resolve":
            sub.add_argument("path")
            sub.add_argument("winner")
        if name == "sync":
            sub.add_argument("--dry-run", action="store_true")
            sub.add_argument("-v", "--verbose", action="store_true")
            sub.add_argument("--manifest-only", action="store_true", help="change the manifests and no file")
            sub.add_argument("--scope", choices=["reference", "path"], default="reference")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if spark is None and args.command != "config":
        spark = SparkSession.builder.appName("concordat").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
