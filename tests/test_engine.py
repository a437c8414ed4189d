"""Conflicts, plans and effects: small scenarios, random manifests against the simulator, derived manifests."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordat.functions import vectors as vv
from concordat.operators import conflicts, effects, planner
from concordat.plans import fixtures, queries
from concordat.sources import manifest

from . import simulator as sim


def text(vector):
    return json.dumps(dict(sorted(vector.items())), separators=(",", ":"))


def frame(spark, files):
    rows = [(d, p, r["hash"], 100, r["mtime"], text(r["vv"]), r["tombstone"], False, None) for d, held in files.items() for p, r in held.items()]
    return spark.createDataFrame(rows, manifest.STATES), spark.createDataFrame([(d, 0) for d in files], manifest.DRIVES)


def row(h, vector, tombstone=False, mtime=100):
    return {"hash": h, "vv": vector, "tombstone": tombstone, "mtime": mtime}


def plan_of(spark, files, scope="reference"):
    states, drives = frame(spark, files)
    won = conflicts.resolve(states, drives).select("path", "winner")
    return [(r["type"], r["source_drive"], r["target_drive"], r["path"], r["new_path"], json.loads(r["version_vector"])) for r in planner.plan(states, drives, won, scope).orderBy("seq").collect()]


def short(ops):
    return [(o[0], o[2], o[3]) for o in ops]


def test_vectors(spark):
    pairs = [({"a": 1}, {"a": 2}, "DOMINATED_BY"), ({"a": 1}, {"b": 1}, "CONCURRENT"), ({}, {"a": 0}, "EQUAL"), ({"a": 2, "b": 1}, {"a": 1}, "DOMINATES"), ({}, {}, "EQUAL"), ({"a": 1, "b": 2}, {"a": 2, "b": 1}, "CONCURRENT")]
    df = spark.createDataFrame([(text(a), text(b), want) for a, b, want in pairs], "a string, b string, want string")
    m, n = vv.parse(F.col("a")), vv.parse(F.col("b"))
    got = df.select("want", vv.compare(m, n).alias("c"), vv.compare(n, m).alias("back"), vv.to_json(vv.merge(m, n)).alias("x"), vv.to_json(vv.merge(n, m)).alias("y"), vv.to_json(vv.merge(vv.merge(m, n), n)).alias("z")).collect()
    turned = {"DOMINATES": "DOMINATED_BY", "DOMINATED_BY": "DOMINATES"}
    for r in got:
        assert r["c"] == r["want"] and r["back"] == turned.get(r["c"], r["c"]) and r["x"] == r["y"] == r["z"]


def test_vector_text(spark):
    df = spark.createDataFrame([('{"b":2, "a\\"\\\\":1}',), (None,), ("{}",), ("{bad",), ('{"big":9223372036854775807}',)], "t string")
    assert [r[0] for r in df.select(vv.to_json(vv.parse(F.col("t"), strict=False))).collect()] == ['{"a\\"\\\\":1,"b":2}', "{}", "{}", None, '{"big":9223372036854775807}']
    with pytest.raises(Exception, match="malformed version vector"):
        df.select(vv.to_json(vv.parse(F.col("t")))).collect()
    bad = spark.createDataFrame([(t,) for t in ('{"a":1', '{"a":-1}', '{"a":"x"}', '{"a":1.5}', '{"a":null}', "[1]", "nothing", "{}", '{"a":0}', None)], "t string")
    assert [r[0] for r in bad.select(vv.malformed(F.col("t"))).collect()] == [True] * 7 + [False] * 3
    m = vv.parse(F.lit('{"a":1}'))
    assert df.limit(1).select(vv.to_json(vv.increment(m, F.lit("a"))), vv.to_json(vv.increment(m, F.lit("b"))), vv.clock(m, F.lit("a")), vv.clock(m, F.lit("z"))).first()[:] == ('{"a":2}', '{"a":1,"b":1}', 1, 0)


def test_copy_replace_remove(spark):
    assert short(plan_of(spark, {"a": {"f": row("h", {"a": 1})}, "b": {}})) == [("COPY", "b", "f")]
    assert short(plan_of(spark, {"a": {"f": row("h2", {"a": 1, "b": 1})}, "b": {"f": row("h1", {"b": 1})}})) == [("REPLACE", "b", "f")]
    assert short(plan_of(spark, {"a": {"f": row("h2", {"a": 2, "b": 1}, True)}, "b": {"f": row("h1", {"b": 1})}})) == [("REMOVE", "b", "f")]
    assert plan_of(spark, {"a": {"f": row("h", {"a": 1})}, "b": {"f": row("h", {"a": 1})}}) == []


def test_rename_and_directories(spark):
    files = {"a": {"new": row("h", {"a": 1}), "old": row("h", {"a": 2}, True)}, "b": {"old": row("h", {"a": 1})}}
    assert plan_of(spark, files) == [("RENAME", "a", "b", "old", "new", {"a": 2})]
    assert short(plan_of(spark, {"a": {"x/y/f": row("h", {"a": 1})}, "b": {}})) == [("MKDIR", "b", "x"), ("MKDIR", "b", "x/y"), ("COPY", "b", "x/y/f")]


def test_tombstone_quorum(spark):
    files = {d: {"f": row("h", {d: 1}, d in "abc")} for d in "abcde"}
    assert short(plan_of(spark, files)) == [("REMOVE", "d", "f"), ("REMOVE", "e", "f")]


@pytest.mark.parametrize("n", [2, 3, 4, 7, 10])
def test_quorum_needs_more_than_half(spark, n):
    for agree, want in ((n // 2 + 1, True), (n // 2, False)):
        files = {f"d{i:02}": {"f": row("same" if i < agree else f"h{i}", {f"d{i:02}": 1})} for i in range(n)}
        states, drives = frame(spark, files)
        assert (conflicts.resolve(states, drives).first()["strategy"] == "MAJORITY_QUORUM") is (want and n > 1)


def test_quorum_threshold_is_honoured_when_given(spark):
    files = {d: {"f": row("same" if d < "d" else d, {d: 1})} for d in "abcde"}
    states, drives = frame(spark, files)
    assert conflicts.resolve(states, drives).first()["strategy"] == "MAJORITY_QUORUM"
    assert conflicts.resolve(states, drives, 0.8).first()["strategy"] == "LAST_WRITE_WINS"


def some_files(seed, drives=4, paths=70):
    rng = random.Random(seed)
    names = [rng.choice(["", "p/", "p/q/", "r/s/t/"]) + f"f{i}" for i in range(paths)]
    ids = "abcde"[:drives]
    vector = lambda: {d: rng.randint(1, 2) for d in ids if rng.random() < 0.4}
    return {d: {p: row(f"h{rng.randint(0, 25)}", vector(), rng.random() < 0.3, rng.choice([0, 5, 9])) for p in names if rng.random() < 0.7} for d in ids}


@pytest.mark.parametrize("seed,scope", [(1, "reference"), (2, "path"), (3, "reference")])
def test_random_manifests_against_the_simulator(spark, seed, scope):
    files = some_files(seed, 3 + seed % 3)
    states, drives = frame(spark, files)
    found = sim.conflicts(files)
    want = {p: sim.resolve(have, len(files)) for p, have in found.items()}
    got = conflicts.resolve(states, drives).collect()
    assert {r["path"]: (r["winner"], r["strategy"]) for r in got} == want
    assert plan_of(spark, files, scope) == sim.plan(files, [(p, want[p][0]) for p in sorted(want)], scope)


#: What an independent account of the rules gives for the derived manifests.
EXPECTED = {
    "sf0.001": {"rows": (199, 172, 160), "paths": 213, "strategies": (13, 13, 26, 13, 13), "reference": (107, 27, 147, 38, 107), "path": (104, 27, 134, 51, 82), "again": {"REPLACE": 66}},
    "sf0.01": {"rows": (999, 866, 800), "paths": 1066, "strategies": (66, 67, 134, 67, 66), "reference": (156, 136, 734, 198, 532), "path": (154, 136, 667, 264, 400), "again": {"REPLACE": 338, "MKDIR": 6, "COPY": 3}},
}


@pytest.mark.parametrize("sf", list(EXPECTED))
def test_derived_manifests(spark, sf):
    d, want = f"/root/testdata/{sf}", EXPECTED[sf]
    states = fixtures.states(spark, d)
    counts = {r["drive_id"]: r["count"] for r in states.groupBy("drive_id").count().collect()}
    assert tuple(counts[x] for x in fixtures.DRIVES) == want["rows"]
    assert states.select("path").distinct().count() == want["paths"]
    got = Counter(r["strategy"] for r in queries.resolve_conflicts(spark, d).collect())
    assert tuple(got[s] for s in (conflicts.DOMINANT, conflicts.QUORUM, conflicts.TOMBSTONE, conflicts.LAST_WRITE, conflicts.COPY_ALL)) == want["strategies"]
    for scope in ("reference", "path"):
        plan = queries._plan(spark, d, scope=scope).collect()
        kinds = Counter(r["type"] for r in plan)
        assert tuple(kinds[k] for k in ("MKDIR", "RENAME", "REPLACE", "REMOVE", "COPY")) == want[scope]
        assert sorted(r["seq"] for r in plan) == list(range(1, len(plan) + 1))
    assert {r["type"]: r["n_ops"] for r in queries.replan_after_apply(spark, d).collect()} == want["again"]


def test_third_plan_is_empty_and_sync_source_saves_a_round(spark):
    files = {"a": {"f": row("x", {"a": 1}, mtime=5), "g": row("g", {"a": 1})}, "b": {"f": row("y", {"b": 1}, mtime=9)}, "c": {}}
    for sync_source, rounds in ((False, 3), (True, 2)):
        states, drives = frame(spark, files)
        for n in range(1, rounds + 1):
            plan = planner.plan(states, drives, conflicts.resolve(states, drives).select("path", "winner"))
            kinds = Counter(r["type"] for r in plan.collect())
            assert bool(kinds) is (n < rounds), (sync_source, n, kinds)
            states = queries._written(effects.apply(plan, states, sync_source))
        held = {(r["drive_id"], r["path"]): r["hash"] for r in states.collect()}
        assert all(held[d, "f"] == "y" and held[d, "g"] == "g" for d in "abc")


def test_effects_of_each_operation(spark):
    files = {"a": {"new": row("h", {"a": 1}), "old": row("h", {"a": 2}, True), "gone": row("z", {"a": 2}, True)}, "b": {"old": row("h", {"a": 1}), "gone": row("z", {"a": 1})}}
    states, drives = frame(spark, files)
    after = effects.apply(planner.plan(states, drives, conflicts.resolve(states, drives).select("path", "winner")), states)
    got = {(r["drive_id"], r["path"]): (r["hash"], r["tombstone"], json.loads(r["version_vector"])) for r in after.collect()}
    assert ("b", "old") not in got and got["b", "new"] == ("h", False, {"a": 2}) and got["b", "gone"] == ("z", True, {"a": 2})


def test_failures_and_manual_resolution(spark):
    files = {"a": {"f": row("x", {"a": 1})}, "b": {"f": row("y", {"b": 3})}, "c": {}}
    states, drives = frame(spark, files)
    ops = spark.createDataFrame([("COPY", "a", "z", "f"), ("COPY", "c", "b", "f"), ("COPY", "a", "c", "f")], "type string, source_drive string, target_drive string, path string")
    assert sorted((r["target_drive"], r["reason"]) for r in effects.failures(ops, states, drives).collect()) == [("b", "source file not in manifest"), ("z", "unknown drive")]
    choices = spark.createDataFrame([("f", "b"), ("nope", "a")], "path string, winner string")
    got = conflicts.resolve_manually(states, drives, choices).collect()
    assert {r["drive_id"]: (r["hash"], r["version_vector"]) for r in got} == {d: ("y", '{"a":1,"b":4}') for d in "abc"}


def test_empty_manifests(spark):
    states, drives = frame(spark, {"a": {}, "b": {}})
    won = conflicts.resolve(states, drives).select("path", "winner")
    assert planner.plan(states, drives, won).collect() == []
    assert conflicts.detect(states).collect() == [] and effects.apply(planner.plan(states, drives, won), states).collect() == []


def test_no_plan_rests_on_a_malformed_vector(spark):
    rows = [("a", "f", "h1", 1, 5, '{"a":1', False, False, None), ("b", "f", "h2", 1, 5, '{"b":1}', False, False, None)]
    states = spark.createDataFrame(rows, manifest.STATES)
    drives = spark.createDataFrame([("a", 1), ("b", 1)], manifest.DRIVES)
    with pytest.raises(Exception, match="malformed version vector"):
        conflicts.detect(states).collect()
    with pytest.raises(Exception, match="malformed version vector"):
        planner.plan(states, drives, None).collect()
