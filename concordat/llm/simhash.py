"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints: 64 bits, a bit is 1 if it is set in over half the XXH64 values of the word shingles of a text.
Two fingerprints link at ``max_distance`` or fewer differing bits. Links are found among *distinct* fingerprints:
each fingerprint enumerates a small Hamming ball within each of its segments, fetches the table entries with such a
segment, and complete distances decide. The radii of the segments follow the general pigeonhole rule: if two
fingerprints differ by at most r bits and sum(radius + 1) > r, one segment differs by at most its radius.

Fingerprints that fall into a crowded table bucket (over ``crowd`` members) take a linear exact way instead: two
fingerprints are within 2h bits if and only if some 64-bit value is within h bits of both, so each enumerates the
ball of h bits around itself, all that share a value are linked to the smallest of them, and no pair is emitted.

Nulls and ties: a null or blank text has fingerprint 0 and links like any other; rows with a null id are
fingerprinted, and a component's id is the smallest non-null id in it (null if there is none); repeated rows are
kept; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .components import connected

BLOCK = 1 << 22
FLUSH = 200_000
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, a bounded number of bytes at a time."""
    at, n = 0, len(text)
    while at < n:
        end = at + BLOCK
        if end < n:
            gap = _GAP.search(text, end)
            end = gap.start() if gap else n
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, ngram: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each word shingle, repeats included; shorter texts give the whole sequence."""
    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    made = False
    for words in word_blocks(text):
        words = carry + words
        if len(words) >= ngram:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
            yield np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[ngram - 1 :].tolist(), strict=False)], np.uint64)
            made = True
            carry = words[len(words) - ngram + 1 :] if ngram > 1 else []
        else:
            carry = words
    if carry and not made:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def _set_bits(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How often each bit is set, by document."""
    out = np.zeros((docs, 64), np.int64)
    as_bytes, base = hashes.view(np.uint8).reshape(-1, 8), doc * 256
    for i in range(8):
        out[:, 8 * i : 8 * i + 8] = np.bincount(base + as_bytes[:, i], minlength=docs * 256).reshape(docs, 256) @ _BITS
    return out


def fingerprints_of(texts: list[bytes], ngram: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the texts."""
    n = len(texts)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            first = owner[0]
            doc = np.repeat(np.array(owner) - first, [len(h) for h in held])
            span = owner[-1] - first + 1
            hashes = np.concatenate(held)
            ones[first : first + span] += _set_bits(hashes, doc, span)
            total[first : first + span] += np.bincount(doc, minlength=span)
        held.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, ngram):
            held.append(hashes)
            owner.append(i)
            size += len(hashes)
            if size >= FLUSH or i - owner[0] >= 500:
                flush()
    flush()
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n)


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of one text's shingle hashes, as a signed long."""
    ones = _set_bits(hashes, np.zeros(len(hashes), np.int64), 1)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[0, 0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(texts, ngram).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def keys_for(max_distance: int, wide: bool = False) -> list[tuple[list[int], int]]:
    """(bits, radius) of each key: two fingerprints within max_distance agree on some key up to its radius of bits.

    Narrow: three segments of 21 or 22 bits whose radii sum to max_distance - 2, so that sum(radius + 1) > max_distance.
    Wide, for max_distance 4: pairs of four blocks of 16 bits. The two blocks that differ least differ in at most one
    bit together, unless each of the four differs in just one: then the first pair, of radius 2, has both.
    """
    if wide:
        if max_distance > 4:
            raise ValueError("wide keys reach a distance of 4")
        blocks = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
        return [(a + b, 2 if i == 0 else 1) for i, (a, b) in enumerate(combinations(blocks, 2))]
    spare = max(0, max_distance - 2)
    cut = [64 * i // 3 for i in range(4)]
    return [(list(range(cut[i], cut[i + 1])), spare // 3 + (i < spare % 3)) for i in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(value: Column, bits: list[int], radius: int) -> Column:
    """Array of ``value`` and all that differ from it in at most ``radius`` of ``bits``, built without a literal a mask."""
    if radius == 0:
        return F.array(value)
    places, one = F.array(*[F.lit(b) for b in bits]), F.lit(1).cast("long")

    def flips(depth: int, first: Column, mask: Column) -> Column:
        """Values with up to ``depth`` more flips at or after place ``first``; a place met twice counts once."""
        step = lambda i: mask.bitwiseOR(F.call_function("shiftleft", one, F.element_at(places, i)))
        inner = lambda i: value.bitwiseXOR(step(i)) if depth == 1 else flips(depth - 1, i, step(i))
        found = F.transform(F.sequence(first, F.lit(len(bits))), inner)
        return found if depth == 1 else F.flatten(found)

    found = F.concat(F.array(value), flips(radius, F.lit(1), F.lit(0).cast("long")))
    return F.array_distinct(found) if radius > 2 else found


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _named(seg: Column, val: Column) -> Column:
    return F.struct(seg.alias("seg"), val.alias("val"))


def _keyed(fps: DataFrame, name: str, keys: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """(name, seg, val): the keys of each fingerprint, or with ``probing`` those of the balls around them."""
    fp, parts = F.col("fp"), []
    for seg, (bits, radius) in enumerate(keys):
        mask = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
        at = fp.bitwiseAND(mask)
        found = ball(at, bits, radius) if probing else F.array(at)
        parts.append(F.transform(found, partial(_named, F.lit(seg).cast("tinyint"))))
    return fps.select(fp.alias(name), F.explode(F.concat(*parts)).alias("s")).select(name, "s.seg", "s.val")


def links(fps: DataFrame, scratch: Scratch, max_distance: int = 4, crowd: int = 256, wide: bool | None = None) -> DataFrame:
    """(u, v) edges whose connected components are those of all pairs of the distinct ``fp`` within max_distance.

    Every pair within max_distance is either an edge or joined through an exact star of a crowded bucket. Keys are
    wide from 2**21 * crowd / 8 fingerprints on, so that an average bucket never is crowded; both kinds are exact.
    """
    if max_distance % 2:  # within 2h + 1 bits: the balls of h bits around one side and h + 1 around the other meet
        raise ValueError("max_distance must be even")
    fp, key = F.col("fp"), ["seg", "val"]
    if wide is None:
        wide = max_distance <= 4 and fps.count() > (1 << 18) * crowd
    keys = keys_for(max_distance, wide)
    table, probe = _keyed(fps, "fp", keys, False), _keyed(fps, "q", keys, True)
    crowded, _, seen = scratch.measured(table.groupBy(key).count().filter(F.col("count") > crowd).select(key))
    some = seen["n"] > 0
    calm = table.join(crowded, key, "left_anti") if some else table
    near = (F.col("q") < fp) & (_distance(F.col("q"), fp) <= max_distance)
    pairs = probe.join(calm, key).filter(near).select(F.col("q").alias("u"), fp.alias("v"))
    if not some:
        return pairs
    inside = probe.join(crowded, key, "left_semi").select(F.col("q").alias("fp")).distinct()
    middle, _ = scratch.write(inside.select("fp", F.explode(ball(fp, list(range(64)), max_distance // 2)).alias("mid")))
    low = middle.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("mid", "v")
    stars = middle.join(low, "mid").filter(fp != F.col("v")).select(fp.alias("u"), "v")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row: the whole job of near-duplicate detection."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    fps, _ = scratch.write(fingerprints(docs, id_col, text_col, ngram))
    distinct, _ = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = connected(spark, links(distinct.select("fp"), scratch, max_distance), scratch).withColumnRenamed("node", "fp")
    named = linked.join(distinct, "fp")
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    # A fingerprint without links is a group of its own, and only such ones have no row in ``named``.
    groups = distinct.join(named, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    return fps.join(groups, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
