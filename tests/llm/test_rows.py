"""Chats, vector search, and the pipeline."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concordat.llm import chatformat, components, queries, topk
from concordat.llm.common import Scratch

from .conftest import SCHEMA, rows_of


def chats():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool|x", "", None]), rng.choice(["hi", "</s>", "<s>[INST] a [/INST]\n", "\\", "\\<", "é<<SYS>>", "", None, "<|end|>\n", "日本" * 50])) for c in range(30) for t in range(rng.randint(1, 9))]
    return rows + [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, None, None, None), (None, 1, "assistant", "x"), (77, None, "assistant", "no turn")]


def test_chats_read_back(spark, monkeypatch):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chatformat.digests(chatformat.format_chats(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=key)]
        learned = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_scatter_in_small_chunks(monkeypatch):
    whole = [chatformat.assemble(pa.array([1]), pa.array([[{"turn": 1, "role": r, "text": t} for r, t in (("user", "abc" * 9), ("assistant", "<é"), ("odd", None))]], pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))))]
    monkeypatch.setattr(chatformat, "CHUNK", 4)
    again = chatformat.assemble(pa.array([1]), pa.array([[{"turn": 1, "role": r, "text": t} for r, t in (("user", "abc" * 9), ("assistant", "<é"), ("odd", None))]], pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))))
    assert whole[0].equals(again) and chatformat.parse(again.column(1)[0].as_py()) == [("user", "abc" * 9), ("assistant", "<é"), ("odd", "")]


def test_chats_in_slices():
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    turns = pa.array([[{"turn": 1, "role": "user", "text": "x" * n}] * k for n, k in ((5, 1), (0, 3), (40, 2), (3, 0), (9, 1))] + [None], kind)
    assert list(chatformat.slices(turns, 20)) == [(0, 2), (2, 3), (3, 6)] and list(chatformat.slices(turns[:0])) == []


def test_long_turn_reads_back_in_bounded_memory():
    import resource

    text = "some [words] <s> \\ of a very long turn é " * 500_000  # 20 million characters
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    made = chatformat.assemble(pa.array([1]), pa.array([[{"turn": 1, "role": "user", "text": text}, {"turn": 2, "role": "assistant", "text": " "}]], kind))
    formatted = made.column(1)[0].as_py()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert chatformat.parse(formatted) == [("user", text), ("assistant", " ")]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    with pytest.raises(ValueError):
        chatformat.parse("[INST] a</s>\n")


def test_chats_empty(spark):
    assert chatformat.digests(chatformat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # one common vector: ties
    rows += [(50, rows[3][1]), (350, None), (351, [1.0, None] + [0.0] * 6), (352, [float("nan")] * 8), (353, [float("inf")] * 8), (None, [0.0] * 8), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (450, []), (500, [1e9] * 8), (501, [3e7] * 8)]
    return rows


def plain_topk(rows, k):
    whole = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in dict.fromkeys(x for x in whole if x[0] % 50 == 0):
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in whole if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_grid():
    for shards, tiles, cells in ((0, 0, 8), (1, 1, 8), (50, 1, 8), (50, 2, 8), (3, 40, 16), (1000, 20, 200), (7, 7, 1)):
        down, across = topk.grid(shards, tiles, cells)
        assert 1 <= down <= max(1, shards) and 1 <= across <= max(1, tiles) and down * across <= cells
        assert 2 * down * across >= min(cells, shards * tiles)
    assert topk.grid(1000, 20, 200)[1] < 6  # shards are many, so few copies of them


def test_topk_runs_in_cells(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = topk.search(df, F.col("vec_id") % 2 == 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Cross" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("tile", [(4096, 512, 1 << 20), (16, 3, 1 << 20), (64, 64, 30)])
def test_topk_is_brute_force(spark, monkeypatch, tile):
    for name, value in zip(("SHARD", "TILE", "BLOCK"), tile, strict=True):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("dim", F.lit("x"))
    got = topk.search(df.repartition(4), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_topk(vectors(), 5)


def test_topk_is_sql_and_empty(spark):
    rows = [r for r in vectors() if r[0] not in (400, 401, 450, 500, 501)]
    con = duckdb.connect()
    con.register("embeddings", pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["vec_id", "embedding"]))
    want = [r for r in con.sql(queries.TOPK_SQL).fetchall() if r[0] != 50]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect() if r[0] != 50) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components.connected(spark, spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()))
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 130)} | {200: 200, 201: 200}
    assert components.connected(spark, spark.createDataFrame([], "u long, v long"), Scratch(spark)).collect() == []


def test_pipeline_stages(spark, crowded, corpus):
    docs = crowded
    names = docs.columns
    told = corpus_pipeline.language_id(spark, docs, "").cache()
    assert told.columns == names
    lettered = [r for r in corpus if any(c.isalpha() for c in r[1] or "")]
    assert rows_of(told, "doc_id", "text") == sorted(((r[0], r[1]) for r in lettered), key=repr)
    lines = corpus_pipeline.line_dedup(spark, told, "").cache()
    assert lines.columns == names and lines.count() == len(lettered)
    assert lines.filter(F.lower("text").contains("common line")).select("text").distinct().count() == 1
    assert lines.filter("n_chars <> char_length(text)").isEmpty()
    near = corpus_pipeline.near_dedup(spark, lines, "").cache()
    kept = Counter(r["doc_id"] for r in near.collect())
    assert near.columns == names and all(n == 1 for d, n in kept.items() if d != 10) and kept[10] == 2  # two texts of one id
    assert sum(500 <= d < 512 for d in kept if d is not None) <= 1
    mixed = corpus_pipeline.mix_sources(spark, near, "").cache()
    assert mixed.columns == [*names, corpus_pipeline.POSITION] and rows_of(mixed.select(*names)) == rows_of(near)
    assert sorted(r[-1] for r in mixed.collect()) == list(range(near.count()))
    last = corpus_pipeline.sentencepiece_ids(spark, mixed, "")
    assert last.columns == ["doc_id", "position", "n_tokens", "ids", "decoded_sha256"]
    assert rows_of(last, "doc_id", "position") == rows_of(mixed, "doc_id", corpus_pipeline.POSITION)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_pipeline_run_is_brute_force(spark, docs, corpus, tmp_path):
    import sentencepiece

    from .test_pipeline import groups, shingles
    from .test_texts import duck

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    rows = [(r[0], r[1], r[3]) for r in corpus if any(c.isalpha() for c in r[1] or "")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    rank = lambda d: (d is None, d or 0)
    holders = {}
    for d, text, _ in rows:
        for k in {key(line) for line in text.split("\n")} - {""}:
            held = holders.setdefault(k, {})
            held[text] = min(held.get(text, rank(d)), rank(d))
    first = {k: min(held, key=held.get) for k, held in holders.items() if len(held) >= 10}
    rows = [(d, "\n".join(line for line in text.split("\n") if first.get(key(line), text) == text), s) for d, text, s in rows]
    comp = groups([shingles(text) for _, text, _ in rows])
    one = {}
    for r, c in zip(rows, comp, strict=True):
        one[c] = min(one.get(c, r), r, key=lambda r: rank(r[0]))
    kept = {(d, s): text for d, text, s in one.values()}
    assert len(kept) == len(one) < len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    want = []
    for d, s, position in duck(queries.mixing_sql(), documents=(list(kept), "doc_id long, source string")).select("doc_id, source, position").fetchall():
        ids = sp.encode(kept[d, s], add_bos=True, add_eos=True)
        want.append((position, d, len(ids), ids, hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((r["position"], r["doc_id"], *r[2:]) for r in got) == sorted(want)
    assert [r["position"] for r in sorted(got, key=lambda r: r["position"])] == list(range(len(kept)))
