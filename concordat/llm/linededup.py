"""Line dedup with levelled sorted runs of line hashes.

A run is a Parquet table in the shared folder, sorted by a 128-bit line hash, with the number of documents that
hold the line. A new batch is counted, merge-anti-joined with the lines already settled (in at least ``min_docs``
documents: they need no more counting) and added as a run of its own at level 0. Whenever a level holds ``fanout``
runs they are merged into one run of the next level. Lines settled at the end are dropped from every document.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys shorter than
``min_chars`` code points are never dropped. Null or empty text counts as one empty line. Each row is a document;
repeated rows count each, unless ``distinct_texts``: then rows of one text count once, so that copies of a document
do not make its lines frequent. With ``keep_first`` a dropped line stays in one text, the one of the smallest id that
holds it (null ids last), and in that text's copies, so that no line vanishes from the corpus. A null id is kept. Other columns of the input travel in ``row`` and never clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """Array of (a, b), the hash of each line's key; null where the key is too short to count."""

    def key(line: Column) -> Column:
        line = F.btrim(line, F.lit(SPACES))
        return F.when(F.char_length(line) >= max(1, min_chars), F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("wide"), line).alias("b")))

    return F.transform(split_lines(F.translate(text, UPPER, LOWER)), key)


class LineRuns:
    """The levelled runs: tables (a, b, n), n being documents counted so far."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2) -> None:
        self.scratch, self.min_docs, self.fanout = Scratch(spark), min_docs, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def counts(self) -> DataFrame | None:
        runs = [run for level in self.levels for run, _ in level]
        if not runs:
            return None
        return reduce(DataFrame.unionByName, runs).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame | None:
        counts = self.counts()
        return None if counts is None else counts.filter(F.col("n") >= self.min_docs).select("a", "b")

    def add(self, batch: DataFrame) -> None:
        """``batch`` (a, b, n): the documents in the batch that hold each line."""
        known = self.settled()
        fresh = batch if known is None else batch.join(known.hint("merge"), ["a", "b"], "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.scratch.write(run.select("a", "b", "n").sortWithinPartitions("a", "b")))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = reduce(DataFrame.unionByName, [run for run, _ in old]).groupBy("a", "b").agg(F.sum("n").alias("n"))
            self._put(level + 1, merged)
            for _, path in old:
                self.scratch.drop(path)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, distinct_texts: bool = False, keep_first: bool = False) -> DataFrame:
    """(row, doc_id, kept, n_lines, n_dropped): ``row`` has all input columns, ``kept`` the lines that stay."""
    spark = docs.sparkSession
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    runs = LineRuns(spark, min_docs, fanout)
    mark = (doc.alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("wide"), text).alias("h2"))
    counting = docs.select(*mark, F.array_distinct(line_keys(text, min_chars)).alias("keys"))
    if distinct_texts:
        counting = counting.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    seen = counting.select(batch.alias("batch"), F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h1", "h2").alias("at"), F.explode("keys").alias("k")).filter("k is not null")
    first = [F.min("at").alias("first")] if keep_first else []
    counted, path = runs.scratch.write(seen.groupBy("batch", "k.a", "k.b").agg(F.count("*").alias("n"), *first))
    for i in range(batches):
        runs.add(counted.filter(F.col("batch") == i).select("a", "b", "n"))
    frequent, _ = runs.scratch.write(runs.settled())
    if keep_first:
        held = counted.join(frequent, ["a", "b"]).groupBy("a", "b").agg(F.min("first").alias("f"))
        frequent, _ = runs.scratch.write(held.select("a", "b", F.col("f.h1").alias("f1"), F.col("f.h2").alias("f2")))
    runs.scratch.drop(path)

    lines = docs.select(*mark, F.posexplode(line_keys(text, min_chars)).alias("pos", "k")).filter("k is not null").select("doc_id", "h1", "h2", "pos", "k.a", "k.b")
    lost = lines.join(frequent, ["a", "b"])
    lost = lost.filter("h1 <> f1 or h2 <> f2") if keep_first else lost
    gone = lost.groupBy("doc_id", "h1", "h2").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "gone")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *mark, text.alias("text"))
    found = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    found = found.select("row", "doc_id", split_lines(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.element_at("lines", p + 1)), "\n"))
    return found.select("row", "doc_id", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
