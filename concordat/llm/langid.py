"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1. The vector of a letter trigram binds (multiplies) the three letters'
vectors, permuted (rotated) by their place; a document's vector bundles (adds) those of its trigrams; a language's
prototype is the sum of the unit vectors of its labelled documents, and a text takes the language whose prototype
has the greatest cosine with its vector. Letters are lower-cased, any run of other characters is one blank.

Fitting reads a bounded sample: about ``per_language`` labelled texts of each language, whole texts, taken by a hash
of the id; over ``LABELS`` different labels are an error. Predictions see the text alone. A null text, one without a letter, or an unfitted profile gives ``und``
and score 0. Ties go to the language first in order. Null ids and repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

DIMS = 512
PIECE = 1 << 20
#: Labels that a fit accepts; ISO 639-3 has under 8,000 languages. More would not be languages, and are refused.
LABELS = 10_000
UND = "und"
_HALF = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to itself if a letter, else to the blank."""
    table = np.full(0x110000, 32, np.uint32)
    codes = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint32)
    table[codes] = codes
    return table


@lru_cache(4096)
def _letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, DIMS, np.int8) * 2 - 1


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Folded code points, single blanks between words and one at each end, a bounded number at a time."""
    table, tail = _letters(), np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        codes = table[np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([tail, codes, [32] if at + PIECE >= len(text) else []]).astype(np.uint32)
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        yield codes
        tail = codes[-2:]


def _vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams, given as packed code points."""
    places = [(grams >> np.uint64(42)), (grams >> np.uint64(21)) & np.uint64(0x1FFFFF), grams & np.uint64(0x1FFFFF)]
    out = np.ones((len(grams), DIMS), np.int8)
    for shift, codes in zip((2, 1, 0), places, strict=True):
        found, back = np.unique(codes, return_inverse=True)
        out *= np.roll(np.stack([_letter_vector(int(c)) for c in found]), shift, axis=1)[back]
    return out


def bundle(texts: list[str | None]) -> np.ndarray:
    """Bundled vectors (float32) of the texts; zeros where there is no letter."""
    out = np.zeros((len(texts), DIMS), np.float32)
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            rows, row = np.unique(np.repeat(owner, [len(h) for h in held]), return_inverse=True)
            grams, col = np.unique(np.concatenate(held), return_inverse=True)
            for at in range(0, len(grams), 8192):
                to = min(len(grams), at + 8192)
                inside = (col >= at) & (col < to)
                counts = np.bincount(row[inside] * (to - at) + col[inside] - at, minlength=len(rows) * (to - at)).reshape(len(rows), to - at)
                out[rows] += counts.astype(np.float32) @ _vectors(grams[at:to]).astype(np.float32)
        held.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for codes in _pieces(text or ""):
            if len(codes) >= 3:
                c = codes.astype(np.uint64)
                held.append((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
                owner.append(i)
                size += len(codes)
                if size >= PIECE or i - owner[0] >= 255:
                    flush()
    flush()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", per_language: int = 2000) -> dict[str, np.ndarray]:
    """Language to unit prototype, from rows whose ``label`` is not null."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), label.cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LABELS + 1).collect()}
    if len(sizes) > LABELS:
        raise ValueError(f"over {LABELS} labels")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(chance < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for lang, row in zip(part.column(0).to_pylist(), _unit(bundle(part.column(1).to_pylist())), strict=True):
                    sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()])], ["lang", "sums"])

    parts = sample.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("i", "x"))
    whole = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = {r["lang"]: np.array(r["x"]) for r in whole.select("lang", F.col("v.x").alias("x")).collect()}  # one row a label
    return {lang: _unit(found[lang][None])[0] for lang in sorted(found)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score), and ``row`` with the columns ``keep`` of the input, the text among them, if given."""
    bound_batches(docs.sparkSession)
    langs = list(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]).astype(np.float32) if langs else np.zeros((1, DIMS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).field(text_col) if keep else part.column(1)
                rows = bundle(texts.to_pylist())
                cosine = np.round(_unit(rows) @ matrix.T, 6)
                best = cosine.argmax(axis=1)
                known = rows.any(axis=1) & bool(langs)
                lang = [langs[b] if k else UND for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), *([part.column(1)] if keep else [])], ["doc_id", "lang_pred", "score", *(["row"] if keep else [])])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*keep).alias("row") if keep else F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double" + (f", row {source.schema['row'].dataType.simpleString()}" if keep else "")
    return source.mapInArrow(run, schema)


def bucket(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: 2 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def identify(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learns from those not held out."""
    prototypes = fit(docs, F.when(F.coalesce(bucket() != 2, F.lit(False)), F.col("lang")), per_language=per_language)
    return predict(docs, prototypes).select("doc_id", F.coalesce(bucket() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
