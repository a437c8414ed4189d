"""Findings on the pipeline: each input here lost rows or text once."""

import random

import corpus_pipeline
import numpy as np
import pytest

from concordat.llm import minhash
from concordat.llm.common import Scratch

from .conftest import SCHEMA


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_groups_of_copies_keep_one_whole_document_each(spark):
    rng = random.Random(3)
    texts = ["\n".join(sentence(rng, 12) for _ in range(4)) for _ in range(3)]
    rows = [(100 * g + i, text, "en", "src0", 1) for g, text in enumerate(texts) for i in range(12)]
    rows += [(1000 + i, sentence(rng, 20) + "\nA common line", "en", "src0", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = corpus_pipeline.line_dedup(spark, docs, "").cache()
    near = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, lines, "").collect()}
    assert {d: t for d, t in near.items() if d < 1000} == {100 * g: text for g, text in enumerate(texts)}
    assert sum(d >= 1000 for d in near) == 12 and [d for d, t in near.items() if "common" in t] == [1000]


def test_many_near_copies_leave_one_whole_text(spark):
    rng = random.Random(9)
    text = [sentence(rng, 12) for _ in range(9)]
    rows = [(50 + i, "\n".join([*text[:4], sentence(rng, 3), *text[4:]]), "en", "src0", 1) for i in range(15)]
    lines = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    near = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, lines, "").collect()}
    assert near[50] == rows[0][1] and all(len(t.split()) == 3 for d, t in near.items() if d != 50)


def test_rows_of_one_id_and_rows_without_an_id(spark):
    rng = random.Random(10)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(5, a, "en", "src0", 1), (5, b, "en", "src0", 1), (5, b, "en", "src1", 2), (7, a, "en", "src0", 1), (None, b, "en", "src0", 1), (None, c, "en", "src0", 1), (None, c, "en", "src0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(5, a), (5, b), (None, c)], key=repr)


def variants(rng, at):
    """Near copies of random texts, on both sides of a similarity of 0.8, and a crowd that links only through its base."""
    out = []
    for cut in range(4, 30, 2):
        base = [sentence(rng, 1) for _ in range(120)]
        out += [" ".join(base), " ".join(base[:-cut] + [sentence(rng, 1) for _ in range(cut)])]
    base = [sentence(rng, 1) for _ in range(120)]
    out.append(" ".join(base))
    for _ in range(30):
        p = rng.randrange(0, 100)
        out.append(" ".join([*base[:p], *(sentence(rng, 1) for _ in range(8)), *base[p + 8 :]]))
    return [(at + i, text) for i, text in enumerate(out)]


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def groups(sets):
    """The class of each set of shingles: all with a Jaccard of 0.8 or more are linked."""
    low = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = low[a], low[b]
                low = [min(ra, rb) if r in (ra, rb) else r for r in low]
    return low


def test_near_dedup_links_at_a_jaccard_of_0_8(spark):
    rows = [*variants(random.Random(4), 0), (900, "short text"), (901, "Short  TEXT"), (902, "short texts"), (903, ""), (904, " \n")]
    low = groups([shingles(text) for _, text in rows])
    docs = spark.createDataFrame([(d, text, "en", "src0", 1) for d, text in rows], SCHEMA).repartition(5)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted({rows[c][0] for c in low})


def test_recall_of_near_dedup_by_similarity(spark):
    """At least 0.99 of the pairs with a Jaccard of 0.8 or more are found, and no pair below links."""
    rng, rows, near = random.Random(12), [], {}
    for i in range(400):
        base = [sentence(rng, 1) for _ in range(rng.randint(60, 200))]
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 25))):
            copy[at] = sentence(rng, 1)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        a, b = (shingles(t) for _, t in rows[-2:])
        near[i] = len(a & b) >= 0.8 * len(a | b)
    docs = spark.createDataFrame([(d, text, "en", "src0", 1) for d, text in rows], SCHEMA).repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    found = {i: 2 * i + 1 not in kept for i in near}
    assert all(2 * i in kept for i in near) and not any(found[i] and not near[i] for i in near)
    assert 100 < sum(near.values()) < 390 and sum(found[i] for i in near if near[i]) >= 0.99 * sum(near.values())


def test_unlabelled_documents_stay(spark):
    rows = [(1, "some words", None, "src0", 1), (2, "日本", None, None, 2), (3, " 12.\n", None, "src0", 4), (4, None, None, "src0", 0), (None, "x", None, "src0", 1)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((rows[i] for i in (0, 1, 4)), key=repr)


@pytest.mark.parametrize("counters", [minhash.COUNTERS, 16])
def test_prefixes_lose_no_pair_of_a_crowd(spark, monkeypatch, counters):
    """Every pair of other roots that reaches 0.8 is a candidate, also when many shingles share a counter."""
    monkeypatch.setattr(minhash, "COUNTERS", counters)
    rng = np.random.default_rng(3)
    common, held = rng.integers(1, 1 << 62, 60), {}
    for c in range(160):
        own = rng.integers(1, 1 << 62, int(rng.integers(0, 16)))
        held[c] = np.unique(np.concatenate([rng.permutation(common)[: int(rng.integers(44, 61))], own]).astype(np.uint64))
    held[200] = np.unique(rng.integers(1, 1 << 62, 70_000).astype(np.uint64))  # over one part of a long prefix
    held[201] = held[200][500:]
    held[202] = held[203] = np.array([5], np.uint64)
    root = {c: 0 if c % 5 == 0 and c < 160 else c for c in held}
    left = spark.createDataFrame([(c, len(h), root[c]) for c, h in held.items()], "cls long, n long, root long")
    sets = spark.createDataFrame([(c, h.tobytes()) for c, h in held.items()], "cls long, shingles binary").repartition(4)
    found = {(r["u"], r["v"]) for r in minhash.prefix_pairs(left, sets, 0.8, Scratch(spark)).collect()}
    wanted = {(a, b) for a in held for b in held if a < b and root[a] != root[b] and minhash.jaccard(held[a], held[b]) >= 0.8}
    assert len(wanted) > 50 and {(200, 201), (202, 203)} <= wanted <= found
    assert all(a < b and root[a] != root[b] for a, b in found)


def test_prefixes_of_no_crowd(spark):
    left = spark.createDataFrame([], "cls long, n long, root long")
    sets = spark.createDataFrame([], "cls long, shingles binary")
    assert minhash.prefix_pairs(left, sets, 0.8, Scratch(spark)).count() == 0
