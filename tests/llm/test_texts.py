"""Text operators against brute force, over the edge-case corpus, the empty table and clashing columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from concordat.llm import fingerprints, langid, licenses, linededup, mixing, queries, simhash, spm, suffixdedup
from concordat.llm.common import Scratch

from .conftest import CLASHING, rows_of


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def duck(sql, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        cols = [c.split() for c in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        con.register(name, pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(cols)], [n for n, _ in cols]))
    return con.sql(sql)


# SimHash


def plain_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, d=4):
    """Classes of the fingerprints."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_is_brute_force(docs, crowded, corpus):
    fps = [plain_fingerprint(r[1]) for r in corpus]
    comp = plain_components(fps)
    low = {}
    for r, c in zip(corpus, comp, strict=True):
        low[c] = min(filter(lambda x: x is not None, [low.get(c), r[0]]), default=None)
    want = sorted(((r[0], f"{f:016x}", low[c]) for r, f, c in zip(corpus, fps, comp, strict=True)), key=repr)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert rows_of(simhash.near_duplicates(crowded), "doc_id", "fingerprint", "component_id") == want


def test_simhash_words_cross_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "FLUSH", 3)
    text = "The quick  brown\tfox jumps\nover THE lazy dog and runs away again"
    got = simhash.fingerprints_of([text.encode(), b"", b"two words"], 4).tolist()
    assert got == [plain_fingerprint(t) for t in (text, "", "two words")]


@pytest.mark.parametrize("crowd,wide", [(256, False), (2, False), (256, True), (2, True)])
def test_simhash_links_in_crowded_buckets(spark, crowd, wide):
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = sorted({c ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for c in centre for _ in range(25)} | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(u % (1 << 64), v % (1 << 64)) for u, v in simhash.links(df, Scratch(spark), crowd=crowd, wide=wide).collect()]
    comp = dict(zip(fps, plain_components(fps), strict=True))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        assert comp[u] == comp[v]
        root[find(u)] = find(v)
    assert len({find(f) for f in fps}) == len(set(comp.values()))


def test_pigeonhole_of_keys():
    rng = random.Random(2)
    for d in range(0, 9):
        for keys in (simhash.keys_for(d), simhash.keys_for(4, wide=True)):
            most = d if len(keys) == 3 else 4
            for _ in range(400):
                flipped = set(rng.sample(range(64), rng.randint(0, most)))
                assert any(len(flipped & set(bits)) <= radius for bits, radius in keys)
    for a in range(16):  # one bit in each block: only the key of radius 2 has it
        flipped = {a, 16 + a, 32 + a, 48 + a}
        assert any(len(flipped & set(bits)) <= radius for bits, radius in simhash.keys_for(4, wide=True))


def test_balls(spark):
    for bits, radius in (([3], 1), (list(range(64)), 1), ([0, 5, 63], 2), (list(range(0, 64, 7)), 3), ([1, 2], 0)):
        got = spark.range(1).select(simhash.ball(F.lit(-12345), bits, radius).alias("b")).first()["b"]
        flips = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(bits, k)]
        assert sorted(x % (1 << 64) for x in got) == sorted(-12345 % (1 << 64) ^ m for m in flips)


# Line dedup


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (5, 3)])
def test_line_dedup_is_sql(docs, corpus, batches, fanout):
    want = duck(queries.LINE_SQL, documents=([r[:2] for r in corpus], "doc_id long, text string")).fetchall()
    got = linededup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert rows_of(got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))) == sorted(want, key=repr)


def test_line_dedup_carries_every_column(crowded):
    got = linededup.dedup_lines(crowded)
    assert got.select("row.*").columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    assert got.filter("n_dropped > 0").count() > 40


# Licences


def test_license_scan_is_sql(docs, corpus):
    want = duck(licenses.scan_sql(), documents=([r[:2] for r in corpus], "doc_id long, text string")).fetchall()
    got = rows_of(licenses.scan(docs), "doc_id", "n_units", "n_matches", "license", "score", "licenses")
    assert got == sorted(want, key=repr)
    assert sum(g[3] == "Apache-2.0" for g in got) >= 9


def test_license_in_a_wrapped_paragraph(spark):
    text = "Intro words here.\n\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation, either version 3\nof the License, or (at your option) any later version.\n\nmore text\nReleased under the MIT  license!"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["license"], row["licenses"], row["n_matches"]) == ("GPL-3.0", "GPL-3.0,MIT", 2) or row["licenses"] == "GPL-3.0,MIT"


# Suffix arrays


def plain_repeats(rows, length):
    low = {}
    for r in rows:
        b, i = (r[1] or "").encode(), r[0] if r[0] is not None else suffixdedup.LAST_ID
        for k in range(len(b) - length + 1):
            low[b[k : k + length]] = min(low.get(b[k : k + length], i), i)
    out = []
    for r in rows:
        b, i = (r[1] or "").encode(), r[0] if r[0] is not None else suffixdedup.LAST_ID
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if low[b[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone[1 : len(b) + 1]]))))
    return sorted(out, key=repr)


def test_suffix_dedup_is_brute_force(docs, crowded, corpus):
    want = plain_repeats(corpus, 50)
    assert rows_of(suffixdedup.remove_repeats(docs, digests=True)) == want
    assert rows_of(suffixdedup.remove_repeats(crowded, digests=True)) == want
    got = suffixdedup.remove_repeats(docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in got), key=repr) == want
    assert sum(b - a for r in got for a, b in zip(r["begins"], r["ends"], strict=True)) == sum(w[2] for w in want)


def in_process(rows, length):
    """All stages without Spark, so that the limits can be set for a test."""
    names = {t: 1000 + i for i, t in enumerate(dict.fromkeys(r[1] or "" for r in rows))}
    marks = [names[r[1] or ""] for r in rows]
    text = pa.array([r[1] for r in rows], pa.string())
    buckets, shards, told, entries = {}, {}, {}, {}
    for out in suffixdedup._report(length, 3)(iter([pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), text], ["mark", "text"])])):
        for r in out.to_pylist():
            buckets.setdefault(r["bucket"], []).append(r)
    for held in buckets.values():
        for r in suffixdedup._judge(pa.Table.from_pylist(held)).to_pylist():
            told.setdefault((r["mark"], r["split"]), []).append(r["anchor"])
    keys = lambda split: pa.array([told.get((m, split)) for m in marks], pa.list_(pa.int64()))
    wide = pa.array([-m for m in marks], pa.int64())
    columns = [pa.array(marks, pa.int64()), text, pa.array([r[0] for r in rows], pa.int64()), wide, keys(False), keys(True), pa.array([marks.count(m) > 1 or None for m in marks])]
    for out in suffixdedup._send(length, 3)(iter([pa.RecordBatch.from_arrays(columns, ["mark", "text", "doc_id", "wide", "send", "split", "copied"])])):
        for r in out.to_pylist():
            shards.setdefault(r["shard"], []).append(r)
    for held in shards.values():
        for r in suffixdedup._sort_shard(length)(pa.Table.from_pylist(held)).to_pylist():
            assert r["wide"] == -r["mark"]
            entries.setdefault(r["mark"], []).append((r["doc"], r["wide"], r["a"], r["b"]))
    out = []
    for m, r in zip(marks, rows, strict=True):
        b = (r[1] or "").encode()
        mine = tuple(np.array(entries.get(m, []), np.int64).reshape(-1, 4).T)
        runs, kept = suffixdedup.cut(b, suffixdedup.spans_of(len(b), r[0], -m, mine, length))
        out.append((r[0], len(b), len(b) - len(kept), len(runs), sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd,block,stretch", [(128, 1 << 23, 1 << 20), (1, 1 << 23, 1 << 20), (2, 3000, 1 << 20), (0, 500, 64), (128, 2000, 100)])
def test_suffix_dedup_with_any_limits(monkeypatch, corpus, crowd, block, stretch):
    for name, value in (("CROWD", crowd), ("BLOCK", block), ("STRETCH", stretch), ("MAX_WINDOWS", 40), ("SHARD_BYTES", 5000)):
        monkeypatch.setattr(suffixdedup, name, value)
    blocks = suffixdedup.blocks
    monkeypatch.setattr(suffixdedup, "blocks", lambda batches, size=block: blocks(batches, size))
    rows = [r for r in dict.fromkeys(corpus) if r[0] is not None]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    assert in_process(rows, 50) == plain_repeats(rows, 50)


def test_suffix_dedup_decides_by_bytes(monkeypatch, corpus):
    """With hashes that hardly tell anything apart, more windows meet and the result is the same."""
    hashes = suffixdedup.substring_hashes
    monkeypatch.setattr(suffixdedup, "substring_hashes", lambda data, size: hashes(data, size) & np.uint64(0xFF))
    rows = [(n, *r[1:]) for n, r in enumerate(dict.fromkeys(r for r in corpus if r[0] is not None))]
    assert in_process(rows, 50) == plain_repeats(rows, 50)


def test_suffix_dedup_of_many_rows_without_an_id(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef ") for _ in range(80))
    rows = [(None if i % 3 else 7 + i % 2, "".join(rng.choice("abcdef ") for _ in range(60)) + shared * (i % 2)) for i in range(300)] + [(3, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(suffixdedup.remove_repeats(df, digests=True)) == plain_repeats(rows, 50)


def test_common_prefixes():
    text = np.frombuffer(b"abcabcabd" + b"\xff" * 5, np.uint8)
    assert suffixdedup.common_prefixes(text, np.array([0, 3, 6, 1]), 4).tolist() == [0, 4, 2, 0]


def test_two_stage_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        text = rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)
        assert suffixdedup.suffix_array(text, 96).tolist() == sorted(range(len(text)), key=lambda i: text.tobytes()[i:])


# Language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.97 * got.count()


def test_language_edges(docs, crowded, empty, corpus):
    got = langid.identify(crowded).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in corpus)
    none = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {701, 702, 703, 706} <= none and all(0 <= r["score"] <= 1 for r in got)
    assert rows_of(langid.identify(docs)) == sorted(map(tuple, got), key=repr)
    assert langid.identify(empty).count() == 0


def plain_profile(text, vectors={}):  # the vectors are kept between calls
    """A text's vector by its definition: rotated letter vectors multiplied for every trigram, then added."""
    folded = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    folded = " " + " ".join(folded.split()) + " "
    total = [0] * langid.DIMS
    if folded.strip():
        for gram, n in Counter(folded[i : i + 3] for i in range(len(folded) - 2)).items():
            if gram not in vectors:
                letters = [langid._letter_vector(ord(c)).tolist() for c in gram]
                vectors[gram] = [letters[0][d - 2] * letters[1][d - 1] * letters[2][d] for d in range(langid.DIMS)]
            total = [t + n * x for t, x in zip(total, vectors[gram], strict=True)]
    norm = sum(t * t for t in total) ** 0.5
    return [t / norm for t in total] if norm else None


def test_language_is_brute_force(docs, corpus):
    held_out = {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in corpus}
    profile = {text: plain_profile(text) for _, text, *_ in corpus}
    sums = {}
    for d, text, lang, *_ in corpus:
        if d is not None and not held_out[d] and lang and profile[text]:
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * langid.DIMS), profile[text], strict=True)]
    cosine = {}
    for text, row in profile.items():
        if row:
            cosine[text] = {g: sum(a * b for a, b in zip(row, s, strict=True)) / sum(x * x for x in s) ** 0.5 for g, s in sums.items()}
    wanted = {(d, text) for d, text, *_ in corpus}
    texts = docs.select("doc_id", "text").distinct()
    got = langid.identify(docs).join(texts.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    one = {d for d, n in Counter(d for d, _ in wanted).items() if n == 1}
    assert len(one) > 150 and len(sums) >= 2
    for r in got:
        if r["doc_id"] not in one:
            continue
        assert r["held_out"] == held_out[r["doc_id"]]
        scores = cosine.get(r["text"])
        if scores is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert abs(min(1, max(0, scores[r["lang_pred"]])) - r["score"]) < 1e-5 and scores[r["lang_pred"]] >= max(scores.values()) - 1e-5


def test_language_sees_the_text_alone(docs):
    """Labels of held-out rows, sources and further columns change no prediction."""
    other = F.when(langid.bucket() == 2, F.lit("xx")).otherwise(F.col("lang")).alias("lang")
    changed = docs.select("doc_id", "text", other, F.lit("elsewhere").alias("source"), F.lit(9).alias("n_chars"))
    assert rows_of(langid.identify(changed)) == rows_of(langid.identify(docs))


def test_language_pieces_do_not_change_vectors(monkeypatch):
    texts = ["Some Words, and more wörds\n\nhere ", None, "", "a", "1 2 3"]
    whole = langid.bundle(texts)
    monkeypatch.setattr(langid, "PIECE", 5)
    assert np.array_equal(whole, langid.bundle(texts)) and not whole[[1, 2, 4]].any() and whole[3].any()


# Fingerprints


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def test_fingerprints_are_brute_force(docs, corpus):
    order = sorted((r[0], r[1] or "") for r in corpus if r[0] is not None)
    after = [(d, t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order)] + [(None, r[1] or "", "") for r in corpus if r[0] is None]
    want = []
    for d, t, n in after:
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        want.append((d, len(t), sha(e), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(n))))
    report = fingerprints.edited_report(docs)
    assert rows_of(report, "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == sorted(want, key=repr)
    forms = {}
    for r in corpus:
        forms.setdefault(r[0], set()).add(canonical(r[1]))
    got = fingerprints.fingerprint(docs).collect()
    assert len({g["fingerprint"] for g in got}) == len({f for s in forms.values() for f in s})
    one = {g["doc_id"]: g["fingerprint"] for g in got}
    assert one[-5] == one[-6] and len(one[-5]) == 32


def test_colliding_fingerprints_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "f", "s1"), (2, "f", "s1"), (3, "f", "s2"), (4, "g", "s3")], "id long, fp string, sha string")
    got = {r["id"]: r["fp"] for r in fingerprints.settled(rows, [("fp", "sha")]).collect()}
    assert got == {1: "f-s1", 2: "f-s1", 3: "f-s2", 4: "g"}


# Mixing


def test_schedule_is_pfair():
    for weights in ({"a": 1}, {"a": 3, "b": 2, "c": 1}, {f"s{i}": 1 + i % 5 for i in range(17)}, {"a": 50, "b": 1}):
        q, used = sum(weights.values()), Counter()
        plan = mixing.schedule(weights)
        assert [p[2] for p in plan] == list(range(q))
        for name, i, slot, release, deadline in plan:
            assert i == used[name] and release <= slot < deadline
            used[name] += 1
            assert all(abs(used[n] - (slot + 1) * a / q) < 1 for n, a in weights.items())


def test_mixing_is_sql(docs, corpus):
    got = mixing.mix(docs, queries.WEIGHTS, queries.BLOCK_DOCS)
    want = duck(queries.mixing_sql(), documents=([(r[0], r[3]) for r in corpus], "doc_id long, source string"))
    mine = got.select("stream", "block", "slot", "release", "deadline", "position")
    assert rows_of(mine) == sorted(want.select("stream, block, slot, release, deadline, position").fetchall(), key=repr)
    assert rows_of(got, "doc_id", "source") == sorted(((r[0], r[3]) for r in corpus), key=repr)


def test_mixing_places_rows_with_clashing_columns(crowded, corpus):
    got = mixing.placed(crowded, {"src0": 2, "src1": 1}, 3, name="place")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING, "place"]
    with pytest.raises(ValueError):
        mixing.placed(crowded, {"src0": 2, "src1": 1}, 3)
    rows = sorted(got.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(len(corpus)))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, ((r[0], r[1]) for r in corpus)))
    streams = [r["source"] if r["source"] in ("src0", "src1") else "rest" for r in rows]
    assert Counter(streams[:48]) == {"src0": 24, "src1": 12, "rest": 12}


def test_mixing_positions_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 2)
    rows = [(i, f"src{i % 3}") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), queries.WEIGHTS, 2)
    order = sorted((r["slot"], r["position"]) for r in got.collect())
    assert [p for _, p in order] == list(range(500))


# SentencePiece


def test_sentencepiece_is_the_library(docs, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    want = []
    for r in corpus:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids))))
    assert rows_of(spm.encode(docs, queries.model_file(), digests=True)) == sorted(want, key=repr)
    coded = spm.encode(docs, queries.model_file()).collect()
    assert sorted(((r["doc_id"], len(r["ids"]), sha(np.array(r["ids"], "<u4").tobytes()), sha(r["decoded"])) for r in coded), key=repr) == sorted(want, key=repr)


def test_sentencepiece_odd_texts(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(spm, "TABLE", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    table = spm.ChunkTable(queries.model_file())
    texts = ["", " ", "  ", "a ", " a", "a  b   c", "▁x▁", "<s> </s> <unk>", "<0x41>", "tab\tnew\nline", "\0x", "𝄞 é é", " " * 40 + "z"]
    for text in texts:
        (ids,) = table.encode([text])
        assert ids.tolist() == sp.encode(text, add_bos=True, add_eos=True), text
        assert table.decode(ids) == sp.decode(ids.tolist())


# Empty tables


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op7", "op9", "op10"])
def test_empty_table(empty, name):
    run = {
        "op1": simhash.near_duplicates, "op2": linededup.dedup_lines, "op3": licenses.scan, "op5": suffixdedup.remove_repeats, "op7": fingerprints.edited_report,
        "op9": lambda d: mixing.placed(d, queries.WEIGHTS), "op10": lambda d: spm.encode(d, queries.model_file()),
    }[name]
    assert run(empty).collect() == []
