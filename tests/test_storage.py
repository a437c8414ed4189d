"""Scans, Merkle trees, chunks, Bloom filters, settings, journal, command line, streaming."""

import hashlib
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat import cli
from concordat.functions import paths
from concordat.operators import bloom, chunking, effects, merkle, scan
from concordat.sources import config, journal, manifest, platform
from concordat.streaming import incremental

NOW = 1_800_000_000


def sha(b):
    return hashlib.sha256(b).hexdigest()


def states(spark, *rows):
    return spark.createDataFrame([(*r, False, None) for r in rows], manifest.STATES)


def listing(spark, *rows):
    return spark.createDataFrame(rows, "drive_id string, path string, size long, mtime long, content_hash string")


def by_path(df):
    return {r["path"]: r for r in df.collect()}


def test_scan_lifecycle(spark):
    old = states(spark, ("a", "same", "cached", 3, 10, '{"a":1}', False), ("a", "changed", "old", 3, 10, '{"a":1}', False), ("a", "lost", "h", 3, 10, '{"a":1}', False), ("a", "dead", "h", 3, 10, '{"a":4}', True), ("a", "back", "h", 3, 10, '{"a":2}', True), ("b", "other", "h", 1, 1, "{}", False))
    seen = listing(spark, ("a", "same", 3, 10, "not read"), ("a", "changed", 3, 11, "new"), ("a", "back", 3, 10, "x"), ("a", "fresh", 1, 1, "f"), ("a", ".git/x", 1, 1, "g"), ("a", "d/.x/y", 1, 1, "g"), ("a", "._x", 1, 1, "g"))
    after = by_path(scan.scan(seen, old, F.lit(NOW), F.col("content_hash")))
    assert set(after) == {"same", "changed", "lost", "dead", "back", "fresh", "other"}
    assert (after["same"]["hash"], after["changed"]["hash"], after["back"]["hash"]) == ("cached", "new", "h")
    assert after["lost"]["tombstone"] and after["lost"]["hash"] == "h" and after["lost"]["version_vector"] == '{"a":2}'
    assert after["dead"]["version_vector"] == '{"a":4}' and not after["back"]["tombstone"] and after["back"]["version_vector"] == '{"a":2}'
    assert after["fresh"]["version_vector"] == "{}" and not after["other"]["tombstone"]
    bumped = by_path(scan.scan(seen, old, F.lit(NOW), F.col("content_hash"), bump_on_change=True))
    assert (bumped["changed"]["version_vector"], bumped["fresh"]["version_vector"], bumped["same"]["version_vector"]) == ('{"a":2}', '{"a":1}', '{"a":1}')


def test_unreadable_files_are_no_tombstones_unless_asked(spark):
    old = states(spark, ("a", "f", "h", 3, 10, "{}", False), ("a", "g", "h", 3, 10, "{}", False))
    errors = spark.createDataFrame([("a", "f", "hash: no")], "drive_id string, path string, reason string")
    seen = listing(spark, ("a", "g", 3, 10, "h"))
    assert not by_path(scan.scan(seen, old, F.lit(NOW), F.col("content_hash"), errors))["f"]["tombstone"]
    assert by_path(scan.scan(seen, old, F.lit(NOW), F.col("content_hash"), errors, parity=True))["f"]["tombstone"]


def test_verify_and_replicas(spark):
    held = states(spark, ("a", "f", "h", 1, 1, "{}", False), ("b", "f", "h", 1, 1, "{}", False), ("c", "f", "h", 1, 1, "{}", False), ("a", ".concordat/x", "h", 1, 1, "{}", False), ("a", "dead", "h", 1, 1, "{}", True))
    disk = spark.createDataFrame([("a", "f", "bad"), ("c", "f", "h")], "drive_id string, path string, actual string")
    got = {(r["drive_id"], r["path"]): r["ok"] for r in scan.verify(held, disk).collect()}
    assert got == {("a", "f"): False, ("b", "f"): False, ("c", "f"): True, ("a", ".concordat/x"): True}
    found = scan.replicas(held, disk, spark.createDataFrame([("a", "f")], "drive_id string, path string"))
    assert [tuple(r) for r in found.collect()] == [("a", "f", "c")]
    marked = held.withColumn("corrupted", F.col("drive_id") == "a")
    assert not effects.restore(marked, found).filter("corrupted and path = 'f'").count()


def plain_tree(files):
    hashes = {}
    for p in files:
        parts = p.split("/")
        for n in range(len(parts)):
            hashes.setdefault("/".join(parts[:n]) or ".", set()).add("/".join(parts[: n + 1]))
    done = dict(files)
    for d in sorted(hashes, key=lambda d: -(0 if d == "." else d.count("/") + 1)):
        done[d] = sha("".join(sorted(done[c] for c in hashes[d])).encode())
    return done


def test_merkle(spark):
    one = {f"{d}/f{i}": sha(f"{d}{i}".encode()) for d in ("x", "x/y", "z") for i in range(4)} | {"top": sha(b"t")}
    two = dict(one)
    two["x/y/f1"] = sha(b"changed")
    del two["z/f0"]
    two["new/file"] = sha(b"n")
    rows = [(d, p, h) for d, t in (("1", one), ("2", two)) for p, h in t.items()]
    nodes = merkle.nodes(spark.createDataFrame(rows, "drive_id string, path string, hash string"))
    got = {(r["drive_id"], r["path"]): r["hash"] for r in nodes.collect()}
    for d, t in (("1", one), ("2", two)):
        assert {p: h for (x, p), h in got.items() if x == d} == plain_tree(t)
    tree = lambda d: nodes.filter(F.col("drive_id") == d)
    assert sorted(map(tuple, merkle.diff(tree("1"), tree("2")).collect())) == [("new/file", "added"), ("x/y/f1", "modified"), ("z/f0", "deleted")]
    assert merkle.diff(tree("1"), tree("1")).collect() == []


def test_merkle_diff_does_not_see_swaps_and_file_against_folder(spark):
    rows = [("1", "d/a", "h1"), ("1", "d/b", "h2"), ("1", "p", "h3"), ("2", "d/a", "h2"), ("2", "d/b", "h1"), ("2", "p/q", "h4")]
    nodes = merkle.nodes(spark.createDataFrame(rows, "drive_id string, path string, hash string"))
    got = merkle.diff(nodes.filter("drive_id = '1'"), nodes.filter("drive_id = '2'")).collect()
    assert [tuple(r) for r in got] == [("p/q", "added")]


def plain_cuts(blob, least, mask, most):
    table = []
    for v in range(256):
        for _ in range(8):
            v = (v >> 1) ^ chunking.POLYNOMIAL if v & 1 else v >> 1
        table.append(v)
    fp, start, out = 0, 0, []
    for i, b in enumerate(blob):
        fp = fp >> 8 ^ table[(fp ^ b) & 255]
        if i + 1 - start >= least and fp & mask == 0 or i + 1 - start >= most:
            out.append(i + 1)
            start, fp = i + 1, 0
    return out + ([len(blob)] if start < len(blob) else [])


def test_chunks_are_sequential_cuts(spark):
    rng = random.Random(1)
    blobs = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 700, 5000, 20_000)] + [b"X" * 3000]
    blobs += [rng.randbytes(n) for n in (1024, 1025, 4096, 9001)]
    for least, mask, most in ((64, 255, 1024), (1, 15, 64), (0, 255, 300), (300, 255, 300), (100, 1, 700)):
        plain = [plain_cuts(b, least, mask, most) for b in blobs]
        assert chunking.cuts(blobs, least, mask, most) == chunking.cuts(blobs, least, mask, most, long=0) == plain
        assert [chunking.long_cuts(b, least, mask, most, block=most) for b in blobs] == plain
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)] + [(99, None)], "n long, content binary")
    got = chunking.chunk(df, "n", F.col("content"), 256, 64, 1024, 600).collect()
    for i, b in enumerate([*blobs, b""]):
        mine = sorted((r["offset"], r["size"], r["hash"]) for r in got if r["id"] == (i if i < len(blobs) else 99))
        assert b"".join(b[o : o + s] for o, s, _ in mine) == b and all(h == sha(b[o : o + s]) for o, s, h in mine)
        assert len(mine) == 1 or len(b) > 600
    with pytest.raises(ValueError):
        chunking.chunk(df, "n", F.col("content"), 10)


def test_chunk_delta_of_a_changed_stretch(spark):
    old = b"X" * (2 << 20)
    new = old[: 512 << 10] + b"Y" * (256 << 10) + old[768 << 10 :]
    df = spark.createDataFrame([("old", bytearray(old)), ("new", bytearray(new))], "id string, content binary")
    chunks = chunking.chunk(df, "id", F.col("content")).cache()
    total = chunks.filter("id = 'new'").count()
    assert 0 < chunking.delta(chunks.filter("id = 'old'"), chunks.filter("id = 'new'")).count() < total


def test_bloom(spark):
    bits, count = bloom.sizing(500, 0.01)
    assert (bloom.sizing(0, 0.1), bloom.size_bytes(9)) == ((1, 1), 2) and count == 7
    for rate in (0, 1, -1):
        with pytest.raises(ValueError):
            bloom.sizing(10, rate)
    plain = lambda s, seed: __import__("functools").reduce(lambda h, c: ((h ^ c) * bloom.PRIME) % (1 << 64), s, bloom.OFFSET ^ (seed * bloom.SEED))
    items = [b"", b"a", "é".encode(), b"long " * 9]
    assert bloom.hashes(items, 3).tolist() == [[plain(s, k) for k in range(3)] for s in items]
    put = spark.range(500).select(F.concat(F.lit("in"), "id").alias("x"))
    ask = put.unionByName(spark.range(5000).select(F.concat(F.lit("out"), "id").alias("x")))
    got = bloom.might_contain(bloom.insert(put, "x", bits, count), ask, "x", bits, count)
    hits = {r["item"] for r in got.filter("might_contain").collect()}
    assert sum(h.startswith("in") for h in hits) == 500 and sum(h.startswith("out") for h in hits) <= 250


def test_paths(spark):
    df = spark.createDataFrame([("a\\b//",), ("/",), ("a/b/c",), ("f",), ("",)], "p string")
    got = df.select(paths.normalize(F.col("p")), paths.parent_dir(F.col("p")), paths.ancestor_dirs(F.col("p")), paths.drive_id(F.col("p"))).collect()
    assert [r[0] for r in got] == ["a/b", "/", "a/b/c", "f", ""]
    assert [r[1] for r in got][2:] == ["a/b", "", ""] and [r[2] for r in got][2:] == [["a/b", "a"], [], []]
    assert [r[3] for r in got] == ["ab", "drive", "abc", "f", "drive"]
    modes = spark.createDataFrame([("755",), ("100644",), ("79x",), ("7",), ("",)], "m string")
    assert [r[0] for r in modes.select(paths.permissions_text(paths.permissions_flags(F.col("m")))).collect()] == ["755", "644", "700", "000", "000"]
    sizes = spark.createDataFrame([(5,), (1536,), (3 << 20,), (5 << 30,)], "n long")
    assert [r[0] for r in sizes.select(paths.format_bytes(F.col("n"))).collect()] == ["5 B", "1.5 KB", "3.0 MB", "5.00 GB"]


def test_log_and_registry(spark):
    log = spark.createDataFrame([(1, "WRITE", "f", 1, False), (2, "WRITE", "g", 1, False), (3, "WRITE", "h", 1, False), (4, "MKDIR", "i", 1, False)], manifest.LOG)
    log = manifest.complete(log, spark.createDataFrame([(3,)], "id long"))
    assert sorted(r["id"] for r in manifest.incomplete(log).collect()) == [1, 2, 4]
    assert {r["id"]: r["completed"] for r in manifest.latest(log).collect()} == {1: False, 2: False, 3: True, 4: False}
    temps = spark.createDataFrame([("f", "hf"), ("g", "torn")], "path string, tmp_hash string")
    held = spark.createDataFrame([("f", "hf"), ("g", "hg")], "path string, hash string")
    assert {r["id"]: r["decision"] for r in effects.recover(log, temps, held).collect()} == {1: "PROMOTE", 2: "DISCARD", 4: "NONE"}


def test_snapshots(spark, tmp_path):
    assert manifest.read(spark, f"file://{tmp_path}/none").collect() == []
    held = states(spark, ("a", "f", "h", 1, 1, "{}", False), ("b", "g", "h", 1, 1, "{}", True))
    manifest.write(held, f"file://{tmp_path}/s", by_drive=True)
    back = manifest.read(spark, f"file://{tmp_path}/s").select(*held.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, held.collect()))
    calls = []
    assert manifest.with_retry(lambda: calls.append(1) or len(calls) > 2 or (_ for _ in ()).throw(OSError()), delay=0) is True


def test_config_and_journal(tmp_path):
    file = tmp_path / "sub" / "c.conf"
    held = config.Config(quorum_threshold=0.7, exclude_patterns=["a", "b"])
    held.save(file)
    assert config.load(file) == held
    file.write_text("# c\nquorum_threshold = 2\nlog_level=warn # x\ncdc_chunk_size=-1\nwhat=1\nbroken\nexclude_patterns= a , ,b\n")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = config.load(file)
    assert len(told) == 4 and (got.quorum_threshold, got.log_level, got.cdc_chunk_size, got.exclude_patterns) == (0.5, "WARNING", 65536, ["a", "b"])
    log = journal.Journal(tmp_path / "x.log", "WARNING", 40)
    assert not log.write("INFO", "quiet") and log.write("ERROR", journal.error("ctx", "m" * 40)) and log.write("ERROR", "next")
    assert len(list(tmp_path.glob("x*.log"))) == 2 and "[ctx]" not in log.path.read_text()
    assert journal.quorum("p", "h", ["a", "b"]) == "QUORUM_RESOLUTION path=p winning_hash=h voters=[a,b]"
    assert journal.progress_bar(0, 0, "x").startswith("[") and " 0% (0/0) x" in journal.progress_bar(0, 0, "x") and log.path.read_text().startswith("[2")
    assert journal.progress_bar(1, 3, "x" * 50).endswith("33% (1/3) ..." + "x" * 37)
    assert isinstance(platform.detect_drives(), list)
    platform.set_permissions(str(file), dict.fromkeys(["owner_read", "owner_write", "others_exec"], True))
    assert platform.get_permissions(str(file))["others_exec"] and not platform.get_permissions(str(file))["group_read"]


def test_command_line(spark, tmp_path, capsys):
    for drive, files in (("a", {"f.txt": "one", "d/g.txt": "two"}), ("b", {"f.txt": "other"})):
        for name, body in files.items():
            (tmp_path / drive / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / drive / name).write_text(body)
    store = ["--store", f"file://{tmp_path}/store"]
    drives = ["--drive", f"a=file://{tmp_path}/a", "--drive", f"b=file://{tmp_path}/b"]
    run = lambda *args: cli.main([args[0], *store, *args[1:]], spark)
    assert run("scan") == 1 and run("scan", *drives) == 0 and run("status") == 0
    assert "a: 2 files, 6 bytes" in capsys.readouterr().out
    assert run("verify", *drives) == 0
    assert run("sync", "--dry-run", "-v") == 0 and "REPLACE: 1" in capsys.readouterr().out
    assert run("sync") == 1 and (tmp_path / "b" / "f.txt").read_text() == "other"  # without folders nothing is done
    assert run("sync", *drives) == 0 and run("conflicts") == 0
    held = cli.Store(spark, store[1])
    assert held.states().filter("drive_id = 'b'").count() == 2
    assert (tmp_path / "b" / "f.txt").read_text() == "one" and (tmp_path / "b" / "d" / "g.txt").read_text() == "two"
    assert manifest.incomplete(held.get("log")).isEmpty() and held.get("log").filter("operation = 'WRITE'").count() == 4
    assert run("verify", "--drive", f"b=file://{tmp_path}/b") == 0
    (tmp_path / "b" / "f.txt").write_text("torn")
    assert run("verify", "--drive", f"b=file://{tmp_path}/b") == 1
    root = held.get("nodes").filter("drive_id = 'a' and path = '.'").select("drive_id", "path", "level")
    assert manifest.node_hash(held.get("nodes"), root).count() == 1
    assert run("resolve", "f.txt", "zzz") == 1 and run("resolve", "f.txt", "b") == 0
    assert cli.main(["config", "--file", str(tmp_path / "c"), "--set", "log_level=debug"]) == 0 and config.load(tmp_path / "c").log_level == "DEBUG"


def test_streamed_listings(spark, tmp_path):
    folder = f"{tmp_path}/in"
    listing(spark, ("a", "f", 1, 1, "h1"), ("a", "g", 1, 1, "h2")).coalesce(1).write.parquet(folder)
    incremental.fold(incremental.listings(spark, folder), f"file://{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    listing(spark, ("a", "f", 2, 5, "h3"), ("a", ".h", 1, 1, "x")).coalesce(1).write.mode("append").parquet(folder)
    incremental.fold(incremental.listings(spark, folder), f"file://{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {r["path"]: r["hash"] for r in manifest.read(spark, f"file://{tmp_path}/out/1").collect()} == {"f": "h3", "g": "h2"}


def test_entry_without_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['concordat.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sync_plan' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
    assert np.__version__


def test_a_scan_reads_only_what_it_must(spark, tmp_path):
    for name in ("kept", "changed", "gone", ".hid"):
        (tmp_path / name).write_text(name)
    found = spark.createDataFrame(scan.files(spark, f"file://{tmp_path}", "a").drop("content").collect(), "drive_id string, path string, size long, mtime long, uri string")
    kept = found.filter("path = 'kept'").first()
    old = states(spark, ("a", "kept", "from the cache", kept["size"], kept["mtime"], "{}", False), ("a", "gone", "h", 4, 1, "{}", False))
    (tmp_path / "gone").unlink()  # after the listing
    got = {r["path"]: (r["content_hash"], r["reason"]) for r in scan.contents(found, old).collect()}
    assert got == {"kept": ("from the cache", None), "changed": (sha(b"changed"), None), "gone": (None, "hash: No such file or directory")}
    plan = scan.contents(scan.files(spark, f"file://{tmp_path}", "a"), old)._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("ReadSchema")[1].split("\n")[0] and "content:binary" not in plan
    errors = scan.errors_of(scan.contents(found, old), F.col("reason"))
    after = by_path(scan.scan(scan.contents(found, old).filter("reason is null"), old, F.lit(NOW), F.col("content_hash"), errors))
    assert not after["gone"]["tombstone"] and after["changed"]["hash"] == sha(b"changed") and ".hid" not in after


def test_files_follow_the_plan(spark, tmp_path):
    for drive, files in (("a", {"f": "new", "d/e/g": "deep", "bad": "not as known"}), ("b", {"f": "old", "x": "moved", "dead": "bye"})):
        for name, body in files.items():
            (tmp_path / drive / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / drive / name).write_text(body)
    (tmp_path / "a" / "f").chmod(0o640)
    held = states(spark, ("a", "f", sha(b"new"), 3, 1, "{}", False), ("a", "d/e/g", sha(b"deep"), 4, 1, "{}", False), ("a", "bad", sha(b"other"), 5, 1, "{}", False))
    ops = spark.createDataFrame([(1, "MKDIR", "", "b", "k/l", None), (2, "RENAME", "a", "b", "x", "y/x"), (3, "REPLACE", "a", "b", "f", None), (4, "COPY", "a", "b", "d/e/g", None), (5, "COPY", "a", "b", "bad", None), (6, "REMOVE", "a", "b", "dead", None), (7, "COPY", "a", "z", "f", None)], "seq long, type string, source_drive string, target_drive string, path string, new_path string")
    roots = {d: str(tmp_path / d) for d in "ab"}
    for _ in range(2):  # a task may run again
        got = {r["seq"]: (r["ok"], r["bytes"]) for kinds in effects.PHASES for r in effects.transfer(ops, held, roots, kinds).collect()}
        assert got == {1: (True, 0), 2: (True, 0), 3: (True, 3), 4: (True, 4), 5: (False, 0), 6: (True, 0), 7: (False, 0)}
    b = tmp_path / "b"
    assert {str(p.relative_to(b)): p.read_text() for p in b.rglob("*") if p.is_file()} == {"f": "new", "d/e/g": "deep", "y/x": "moved"}
    assert (b / "k" / "l").is_dir() and (b / "f").stat().st_mode & 0o777 == 0o640


def test_log_goes_on_and_rebuild_empties(spark, tmp_path):
    ops = spark.createDataFrame([(1, "WRITE", "f"), (2, "REMOVE", "g")], "seq long, operation string, path string")
    log = manifest.begin(manifest.begin(spark.createDataFrame([], manifest.LOG), ops, F.lit(NOW)), ops, F.lit(NOW))
    assert [r["id"] for r in manifest.incomplete(log).collect()] == [1, 2, 3, 4]
    store = cli.Store(spark, f"file://{tmp_path}/s")
    store.put(log, "log")
    (tmp_path / "s" / "log" / "1").mkdir()  # a torn snapshot
    assert store.get("log").count() == 4
    store.put(log.limit(1), "log")
    assert store.get("log").count() == 1
    store.rebuild()
    assert store.get("log").count() == 0 and store.states().count() == 0
