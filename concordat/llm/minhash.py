"""Near-duplicates by Jaccard similarity of word shingles: two searches give candidates, exact sets decide.

Texts with the same set of shingle hashes (XXH64, as in SimHash) are one class. Candidates are the links of the
classes' SimHash fingerprints by multi-index hashing, at up to four differing bits, and, since such links reach no
lower than a Jaccard of about 0.95, classes that share a band of minimal hashes: a class has BANDS x ROWS of them, and
two meet with probability 1 - (1 - J^ROWS)^BANDS, 99.93 % at a Jaccard of 0.8, 99.999 % at 0.85. A candidate links
only if the Jaccard of the whole sets, not an estimate, reaches the threshold.

Crowded buckets (over ``crowd`` classes): first each class meets the ``centres`` smallest ones of the bucket, linear
in its size. Classes of a crowd that are then still in different components go through an exact similarity join by
prefixes: with its shingles in order of their frequency among these classes, a set of n can reach the threshold t with
another only if they share one of its first n - ceil(t n) + 1, with enough left behind it in both. These are its
rarest, mostly its own, so texts of a crowd that do not link hardly meet. The frequencies come from a table of COUNTERS
counters; shingles that share one are ordered by their hashes, and as any order common to all sets is exact, this can
only cost pairs to verify. Pairs inside one component cannot change the groups and are left out.

A text without words is the class of the empty set and links to no other. A null id is kept (a group of such rows
alone has a null component_id); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .components import connected
from .simhash import fingerprint_of_hashes, links, shingle_hashes

BANDS, ROWS = 24, 6
CROWD, CENTRES = 16, 4
_SLICE = 2048
LOOK = 8
#: Counters that order the shingles of crowds, 4 MB in every task whatever the input (a power of two).
COUNTERS = 1 << 20
_PART = 1 << 16
#: Odd multipliers: with them a 64-bit hash is permuted, and the smallest product is a minimal hash.
_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def all_hashes(text: bytes, ngram: int) -> np.ndarray:
    found = list(shingle_hashes(text, ngram))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: bytes, ngram: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(all_hashes(text, ngram))


def class_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One signed long a band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _SLICE):
        np.minimum(low, (hashes[at : at + _SLICE] * _FACTORS[:, None]).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, h1, h2, cls, n, fp, bands) of rows (doc_id, h1, h2, text)."""
    schema = "doc_id long, h1 long, h2 long, cls long, n long, fp long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in _bytes(batch.column(3)):
                hashes = all_hashes(text, ngram)
                held = np.unique(hashes)
                made.append((class_of(held), len(held), fingerprint_of_hashes(hashes), bands_of(held)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def _sets(texts: DataFrame, ngram: int) -> DataFrame:
    """(cls, shingles) of (cls, text): the set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, ngram).tobytes() for t in _bytes(part.column(1))], pa.binary())], ["cls", "shingles"])

    return texts.mapInArrow(run, "cls long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            good = pa.array([jaccard(a, b) >= threshold for a, b in zip(*read, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(good)

    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("cls").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def fingerprint_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u < v: classes whose fingerprints link, through the smallest class of each fingerprint."""
    low, _ = scratch.write(classes.groupBy("fp").agg(F.min("cls").alias("low")))
    same = classes.join(low, "fp").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    u, v = (low.select(F.col("fp").alias(c), F.col("low").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    linked = links(low.select("fp"), scratch).join(u, "u").join(v, "v").select("a", "b")
    return same.unionByName(linked).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _near(a, b, threshold: float):
    """Sizes that can reach the threshold."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - F.lit(1e-9)


def _often(sets: DataFrame) -> np.ndarray:
    """How often shingles of ``sets`` (shingles) fall on each of COUNTERS counters, by their low bits; 0 for once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for shingles in batch.column(0).to_pylist():
                np.add.at(held, np.frombuffer(shingles, np.int64) & (COUNTERS - 1), 1)
        found = np.flatnonzero(held)
        for at in range(0, len(found), _PART):
            part = found[at : at + _PART]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], ["counter", "often"])

    counted = sets.mapInArrow(run, "counter long, often long").groupBy("counter").agg(F.sum("often").alias("often")).filter("often > 1").toArrow()
    table = np.zeros(COUNTERS, np.int32)
    table[counted["counter"].to_numpy()] = np.minimum(counted["often"].to_numpy(), np.iinfo(np.int32).max)
    return table


def prefix_pairs(left: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(u, v), u < v: all pairs of the classes ``left`` (cls, n, root), of different roots, that can reach the threshold.

    A pair may come more than once, but not again for a shingle with another common one among the LOOK before it.
    """
    sized, _ = scratch.write(left.join(sets, "cls").select("cls", "n", "root", "shingles"))
    often = left.sparkSession.sparkContext.broadcast(_often(sized.select("shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, held in enumerate(batch.column(3).to_pylist()):
                token = np.frombuffer(held, np.int64)
                seen = often.value[token & (COUNTERS - 1)]
                # Shingles of one class alone come first in its order, and meet nobody: they only shorten the prefix.
                own, size = int(np.count_nonzero(seen == 0)), len(token) - math.ceil(threshold * len(token) - 1e-9) + 1
                prefix = token[np.lexsort((token, seen))[own:size]]
                for at in range(0, len(prefix), _PART):
                    place = np.arange(at, min(at + _PART, len(prefix)))
                    ends = np.concatenate([[0], np.cumsum(np.minimum(place, LOOK))])
                    inside = np.arange(ends[-1]) + np.repeat(np.maximum(place - LOOK, 0) - ends[:-1], np.diff(ends))
                    before = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix[inside]))
                    same = [pa.array(np.full(len(place), batch.column(k)[i].as_py())) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(len(token) - own - place), before, pa.array(prefix[place])], ["cls", "n", "root", "rest", "before", "token"])

    # From its first common shingle on, a pair has no more shingles in common than either set has left.
    prefix, _ = scratch.write(sized.mapInArrow(run, "cls long, n long, root long, rest long, before array<long>, token long"))
    u, v = (prefix.select("token", *[F.col(a).alias(f"{b}{c}") for a, b in (("cls", ""), ("n", "n_"), ("root", "root_"), ("rest", "rest_"), ("before", "before_"))]) for c in "uv")
    enough = F.least("rest_u", "rest_v") >= F.lit(threshold / (1 + threshold)) * (F.col("n_u") + F.col("n_v")) - F.lit(1e-9)
    meet = (F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & _near(F.col("n_u"), F.col("n_v"), threshold) & enough
    return u.join(v, "token").filter(meet & ~F.arrays_overlap("before_u", "before_v")).select("u", "v")


def text_hashes(text: Column) -> list[Column]:
    """h1 and h2, 128 bits that stand for a text."""
    text = text.cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("wide"), text).alias("h2")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.8, crowd: int = CROWD, centres: int = CENTRES) -> DataFrame:
    """(doc_id, h1, h2, root, component_id) of every row: hashes of its text, its group and the group's smallest id."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    text = F.col(text_col).cast("string")
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_hashes(text), text.alias("text"))
    rows, _ = scratch.write(signatures(marked, ngram))
    # One text of each class stands for it.
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min(F.struct("h1", "h2", "n", "fp", "bands")).alias("r")).select("cls", "r.*")
    classes, _ = scratch.write(classes)
    entries = classes.select("cls", "n", F.explode("bands").alias("val"))
    size = entries.groupBy("val").agg(F.count("*").alias("size")).filter("size > 1")
    shared, _ = scratch.write(entries.join(size, "val"))
    u, v = (shared.select("val", "size", F.col("cls").alias(c), F.col("n").alias(f"n_{c}")) for c in "uv")
    v = v.drop("size")
    possible = (F.col("u") < F.col("v")) & _near(F.col("n_u"), F.col("n_v"), threshold)
    small = u.filter(F.col("size") <= crowd).join(v, "val").filter(possible).select("u", "v")
    part = F.pmod(F.xxhash64("cls"), F.lit(centres))
    crowded = shared.filter(F.col("size") > crowd)
    centre = crowded.groupBy("val").agg(F.array(*[F.min(F.when(part == i, F.struct("cls", "n"))) for i in range(centres)]).alias("c")).select("val", F.explode(F.filter("c", lambda c: c.isNotNull())).alias("c"))
    stars = crowded.join(centre, "val").filter((F.col("cls") != F.col("c.cls")) & _near(F.col("n"), F.col("c.n"), threshold)).select(F.least("cls", "c.cls").alias("u"), F.greatest("cls", "c.cls").alias("v"))
    pairs, _ = scratch.write(small.unionByName(stars).unionByName(fingerprint_pairs(classes, scratch)).distinct())

    held = crowded.select("cls").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("cls"))).distinct()
    chosen = classes.select("cls", "h1", "h2").join(held, "cls", "left_semi")
    sets, _ = scratch.write(_sets(marked.join(chosen, ["h1", "h2"]).select("cls", "text").dropDuplicates(["cls"]), ngram))
    edges, _ = scratch.write(_verified(pairs, sets, threshold))
    linked = connected(spark, edges, scratch)

    label = crowded.select("val", "cls", "n").join(linked.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    split = label.groupBy("val").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("val")
    left, _ = scratch.write(label.join(split, "val", "left_semi").select("cls", "n", "root").distinct())
    rest = prefix_pairs(left, sets, threshold, scratch).distinct().join(pairs, ["u", "v"], "left_anti")
    more, _ = scratch.write(_verified(rest, sets, threshold))
    if not more.isEmpty():
        linked = connected(spark, edges.unionByName(more), scratch)

    rooted = rows.select("doc_id", "h1", "h2", "cls").join(linked.select(F.col("node").alias("cls"), "root"), "cls", "left")
    rooted = rooted.select("doc_id", "h1", "h2", F.coalesce("root", "cls").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
