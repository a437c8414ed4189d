"""Canonical exact document fingerprints.

A text's canonical form: NFKC, full case folding, NFKC again, every run of Unicode white space one blank, none at
the ends. The fingerprint is 128 bits of xxhash64 (two seeds) over its UTF-8; rows are grouped by it, and inside a
bucket the contents are compared (by the SHA-256 of all canonical bytes, so that no text is shuffled for it), so
different forms never share a fingerprint: should one bucket hold more than one form, that digest is appended.

An exact digest has no partial likeness: it is 1 where the canonical forms are the same, byte by byte, else 0.
A null text is empty. Rows follow each other by ascending id, then text; rows with a null id have no successor (an
empty next text). Repeated rows are kept and follow each other. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Java class and method of Unicode's own algorithms, called inside the JVM.
NORMALIZER, FOLDER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def nfkc(text: Column) -> Column:
    return F.reflect(F.lit(NORMALIZER), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    plain = F.coalesce(text.cast("string"), F.lit(""))
    folded = nfkc(F.reflect(F.lit(FOLDER), F.lit("foldCase"), nfkc(plain), F.lit(True)))
    # A text of ASCII letters is in NFKC already and folds by lower().
    form = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(folded)
    return F.btrim(F.regexp_replace(form, r"(?U)\s+", " "), F.lit(" "))


def digest(form: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), form)), 16, "0")))


def settled(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Compares contents inside equal buckets: ``pairs`` of a fingerprint and the SHA-256 of all bytes of its form.

    A bucket of one content keeps its fingerprint; in any other, the content's SHA-256 is appended. Grouping carries
    digests only, so a bucket with a third of all rows is two partial aggregates.
    """
    every = reduce(DataFrame.unionByName, [rows.select(F.col(fp).alias("fp"), F.col(sha).alias("sha")) for fp, sha in pairs])
    bad = every.groupBy("fp").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).filter("lo <> hi").select(F.col("fp").alias("_bad"))
    if bad.isEmpty():
        return rows
    for fp, sha in pairs:
        rows = rows.join(bad, F.col(fp) == F.col("_bad"), "left").withColumn(fp, F.when(F.col("_bad").isNotNull(), F.concat(fp, F.lit("-"), sha)).otherwise(F.col(fp))).drop("_bad")
    return rows


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, form_sha) of every row, after the comparison inside equal buckets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    rows, _ = Scratch(docs.sparkSession).write(rows.select("doc_id", digest(F.col("form")).alias("fingerprint"), F.sha2("form", 256).alias("form_sha")))
    return settled(rows, [("fingerprint", "form_sha")])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each row and the text of the row after it, the first after the last.

    Rows are dealt into id ranges bounded by quantiles of the ids. A bound is itself an id, so the first rows of a
    range are found by a filter; copies of them close the range before, and one window per range does the rest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = partitions(docs.sparkSession, 4)
    stats = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20 * count).alias("cuts")).first()
    if stats["low"] is None:
        return rows.withColumn("next_text", F.lit(""))
    bounds = sorted({stats["low"], *(stats["cuts"] or [])})
    home = F.when(F.col("doc_id").isNotNull(), F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("doc_id"))) - 1)
    own = rows.filter("doc_id is not null").select("doc_id", "text", home.alias("range"), F.lit(0).alias("guest"))
    guest = rows.filter(F.col("doc_id").isin(bounds)).select("doc_id", "text", F.pmod(home - 1, F.lit(len(bounds))).alias("range"), F.lit(1).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    paired = own.unionByName(guest).withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")
    return paired.unionByName(rows.filter("doc_id is null").withColumn("next_text", F.lit("")))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: fingerprints of each text and of its edited text, and their likeness."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = with_next(docs, id_col, text_col).select("doc_id", "text", edited.alias("edited"), "next_text")
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"))
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("form")).alias("fingerprint"), digest(F.col("edited_form")).alias("edited_fingerprint"),
        F.sha2("form", 256).alias("form_sha"), F.sha2("edited_form", 256).alias("edited_sha"),
        (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"), (F.col("form") == F.col("next_form")).cast("double").alias("near_next"),
    )
    rows, _ = Scratch(docs.sparkSession).write(rows)
    return settled(rows, [("fingerprint", "form_sha"), ("edited_fingerprint", "edited_sha")]).drop("form_sha", "edited_sha")
