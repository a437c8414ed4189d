"""Corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, SentencePiece ids.

Each stage takes the documents its predecessor kept. All but the last return the columns of ``documents``. Language
ID drops documents without a letter and corrects ``lang`` (if none is labelled it stays as it is). Line dedup cuts
lines found in ten or more distinct texts (copies of a document count once) but for one text each, the one of the
smallest id that holds the line. Near-dedup keeps one row of each group: the smallest id, null ids last, among rows
of one id the smallest hashes of the text. Mixing gives each row its place in the schedule, in one more column,
``mix_position``, as no table keeps an order. The last returns (doc_id, position, n_tokens, ids, decoded_sha256).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.llm import langid, linededup, minhash, mixing, spm
from concordat.llm.common import Scratch
from concordat.llm.queries import BLOCK_DOCS, WEIGHTS, model_file

#: Words of a shingle, and the Jaccard similarity of shingle sets from which texts link.
NGRAM, SIMILARITY = 5, 0.8
#: The column that carries a document's place in the mix.
POSITION = "mix_position"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = langid.fit(docs, F.col("lang"))
    if not prototypes:  # nothing is labelled: no language can be told, and only texts without a letter go
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    told = langid.predict(docs, prototypes, keep=docs.columns)
    kept = told.filter(F.col("lang_pred") != langid.UND)
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(docs, distinct_texts=True, keep_first=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(docs, ngram=NGRAM, threshold=SIMILARITY)
    keys = ["no", "id", "h1", "h2"]
    key = [F.col("doc_id").isNull().alias("no"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    stay = groups.groupBy("root").agg(F.min(F.struct(*key, "h1", "h2")).alias("k")).select("k.*").distinct()
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *key, *minhash.text_hashes(docs["text"]), F.xxhash64(*[docs[c] for c in docs.columns]).alias("rest"))
    # Rows of one id and text lie together already: one of them stays.
    one = Window.partitionBy(*keys).orderBy("rest")
    return whole.join(stay, keys).withColumn("at", F.row_number().over(one)).filter("at = 1").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.placed(docs, WEIGHTS, BLOCK_DOCS, name=POSITION)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    place = F.col(POSITION) if POSITION in docs.columns else F.lit(None).cast("long")
    coded = spm.encode(docs, model_file(), keep=place)
    return coded.select("doc_id", F.col("kept").alias("position"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", sentencepiece_ids)]

#: The first stage's vectors cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
