"""The opN_ queries with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, fingerprints, langid, licenses, linededup, mixing, simhash, spm, suffixdedup, topk

#: Target weights of the mix: sources not named share the stream ``rest``.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}
BLOCK_DOCS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chatformat.digests(chatformat.format_chats(rows.unionByName(extra)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, BLOCK_DOCS).drop("row_hash")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), model_file(), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_simhash, op2_line_dedup, op3_license_scan, op4_chat_format, op5_suffix_dedup, op6_language_id, op7_fingerprints, op8_topk, op9_mixing, op10_sentencepiece)
    return {f.__name__: f for f in named}


LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
frequent AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, frequent.key IS NOT NULL AS gone FROM k LEFT JOIN frequent USING (key))
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


def mixing_sql() -> str:
    weights = WEIGHTS | {mixing.REST: 1}
    names = ", ".join(f"('{n}', {a})" for n, a in weights.items())
    plan = ", ".join(f"('{n}', {i}, {at}, {first}, {last})" for n, i, at, first, last in mixing.schedule(weights))
    q = sum(weights.values())
    return f"""
WITH w(stream, a) AS (VALUES {names}), plan(stream, place, slot0, release0, deadline0) AS (VALUES {plan}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({', '.join(f"'{n}'" for n in WEIGHTS)}) THEN source ELSE '{mixing.REST}' END AS stream FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS n FROM d),
b AS (SELECT r.*, a, n // {BLOCK_DOCS} AS block, n % {BLOCK_DOCS} AS inside FROM r JOIN w USING (stream)),
s AS (SELECT b.*, (block // a) * {q} + slot0 AS slot, (block // a) * {q} + release0 AS release, (block // a) * {q} + deadline0 AS deadline
  FROM b JOIN plan p ON p.stream = b.stream AND p.place = block % a)
SELECT doc_id, source, stream, block, slot, release, deadline, row_number() OVER (ORDER BY slot, inside) - 1 AS position FROM s"""


CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g')) + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 16 WHEN 'assistant' THEN 8 ELSE length(role) + length(regexp_replace(role, '[^\\\\<\\[|]', '', 'g')) + 12 END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_SQL, "op3_license_scan": licenses.scan_sql(), "op4_chat_format": CHAT_SQL, "op8_topk": TOPK_SQL, "op9_mixing": mixing_sql()}
