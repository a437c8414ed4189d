"""Manifests of three drives derived from the driver's tables, and the same as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifest

DRIVES = ["drive_a", "drive_b", "drive_c"]
BASE_TIME = 1_700_000_000

#: By id modulo 15, what each drive has: (content 1 to 3, vector, tombstone, seconds after the base time
#: or None for time 0, corrupted, moved).
A, B, C = '{"drive_a":1}', '{"drive_b":1}', '{"drive_c":1}'
A2, AB = '{"drive_a":2}', '{"drive_a":1,"drive_b":1}'
RULES = [
    (0, "drive_a", 1, A, False, 0, False, False), (0, "drive_b", 1, A, False, 0, False, False), (0, "drive_c", 1, A, False, 0, False, False),
    (1, "drive_a", 1, A, False, 0, False, False),
    (2, "drive_c", 1, C, False, 0, False, False),
    (3, "drive_a", 2, A2, False, 10, False, False), (3, "drive_b", 1, A, False, 0, False, False), (3, "drive_c", 1, A, False, 0, False, False),
    (4, "drive_a", 1, A, False, 0, False, False), (4, "drive_b", 2, AB, False, 10, False, False), (4, "drive_c", 1, A, False, 0, False, False),
    (5, "drive_a", 1, A, False, 0, False, False), (5, "drive_b", 2, B, False, 0, False, False), (5, "drive_c", 2, C, False, 0, False, False),
    (6, "drive_a", 1, A, False, 0, False, False), (6, "drive_b", 1, B, True, 0, False, False),
    (7, "drive_a", 1, A, False, 0, False, False), (7, "drive_b", 2, B, False, 5, False, False), (7, "drive_c", 3, C, False, 9, False, False),
    (8, "drive_a", 1, A, True, 0, False, False), (8, "drive_b", 1, B, True, 0, False, False), (8, "drive_c", 1, C, False, 0, False, False),
    (9, "drive_a", 1, A2, True, 0, False, False), (9, "drive_b", 1, A, False, 0, False, False), (9, "drive_c", 1, A, False, 0, False, False),
    (10, "drive_a", 1, AB, False, 0, False, False), (10, "drive_b", 1, B, True, 0, False, False), (10, "drive_c", 1, AB, False, 0, False, False),
    (11, "drive_a", 1, A2, True, 0, False, False), (11, "drive_a", 1, A, False, 0, False, True), (11, "drive_b", 1, A, False, 0, False, False), (11, "drive_c", 1, A, False, 0, False, False),
    (12, "drive_a", 1, "{}", False, 0, False, False), (12, "drive_b", 2, "{}", False, 0, False, False),
    (13, "drive_a", 1, A, False, None, False, False), (13, "drive_b", 2, B, False, None, False, False), (13, "drive_c", 3, C, False, None, False, False),
    (14, "drive_a", 1, A, False, 0, True, False), (14, "drive_b", 1, A, False, 0, False, False), (14, "drive_c", 1, A, False, 0, False, False),
]
RULE_FIELDS = "k bigint, drive_id string, content int, version_vector string, tombstone boolean, later bigint, corrupted boolean, moved boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, BASE_TIME + i) for i, d in enumerate(DRIVES)], manifest.DRIVES)


def _ruled(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """States of ``rows`` (k, path, h1, h2, h3, size, at): the rules are a constant of a few dozen rows."""
    rules = F.broadcast(spark.createDataFrame(RULES, RULE_FIELDS))
    content = F.when(F.col("content") == 1, F.col("h1")).when(F.col("content") == 2, F.col("h2")).otherwise(F.col("h3"))
    return rows.join(rules, "k").select(
        "drive_id", F.when(F.col("moved"), F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"), content.alias("hash"),
        F.when(F.col("content") == 1, F.col("size")).otherwise(F.col("size") + 2).alias("size"),
        F.when(F.col("later").isNull(), F.lit(0)).otherwise(F.col("at") + F.col("later")).cast("long").alias("mtime"),
        "version_vector", "tombstone", "corrupted", F.lit(None).cast("long").alias("inode"),
    )


def doc_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, k, path, h1, h2, h3, size, at) of the documents that stand in for files."""
    text = F.coalesce("text", F.lit(""))
    digest = lambda tail: F.sha2(F.concat(text, F.lit(tail)), 256)
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 15).alias("k"), doc_path().alias("path"), F.sha2(text, 256).alias("h1"), digest("#2").alias("h2"), digest("#3").alias("h3"), F.octet_length(text).cast("long").alias("size"), (F.lit(BASE_TIME) + F.col("doc_id")).alias("at"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(documents(spark, sf_dir), spark)


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large manifest for the bench: one file an order."""
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string"))
    path = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")))
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 15).alias("k"), path.alias("path"), F.sha2(line, 256).alias("h1"), F.sha2(F.concat(line, F.lit("#2")), 256).alias("h2"), F.sha2(F.concat(line, F.lit("#3")), 256).alias("h3"), F.octet_length(line).cast("long").alias("size"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return _ruled(rows, spark)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of drive_b finds: its live files less the vanished ones, some touched, and hidden ones beside."""
    live = states(spark, sf_dir).filter("drive_id = 'drive_b' and not tombstone")
    doc = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long")
    seen = live.withColumn("doc_id", doc).filter("doc_id % 11 <> 0").select("drive_id", "path", "size", F.when(F.col("doc_id") % 13 == 0, F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"), F.col("hash").alias("content_hash"))
    hidden = documents(spark, sf_dir).filter("doc_id % 7 = 0").select(F.lit("drive_b").alias("drive_id"), F.concat(F.lit(".hidden/"), F.col("path")).alias("path"), "size", F.col("at").alias("mtime"), F.col("h1").alias("content_hash"))
    return seen.unionByName(hidden)


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive_id, path, actual): contents on disk; a corrupted row's file has other bytes, every 17th is missing."""
    rows = states(spark, sf_dir).filter("not tombstone")
    doc = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long")
    return rows.filter((doc % 17 != 0) | (F.col("drive_id") != "drive_c")).select("drive_id", "path", F.when(F.col("corrupted"), F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")).alias("actual"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation log from the events: clicks are writes; one in five never completed."""
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "click", "WRITE").otherwise(F.upper("event_type"))
    return events.select(F.col("event_id").alias("id"), op.alias("operation"), F.concat(F.lit("f/"), F.col("event_id").cast("string")).alias("path"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), (F.col("event_id") % 5 != 0).alias("completed"))


def temps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, tmp_hash) of temporary files left behind, and by ``log_states`` the manifest they belong to."""
    rows = table(spark, sf_dir, "events").filter("event_id % 3 <> 0")
    body = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.lit("torn"))
    return rows.select(F.concat(F.lit("f/"), F.col("event_id").cast("string")).alias("path"), F.sha2(body, 256).alias("tmp_hash"))


def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("f/"), F.col("event_id").cast("string")).alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))


def _lit(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)


def states_sql() -> str:
    """CTEs docs, rules, drives and fs (the states, with the clocks a, b, c as numbers and the live flag)."""
    rules = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in RULES)
    return f"""
rules(k, drive_id, content, version_vector, tombstone, later, corrupted, moved) AS (VALUES {rules}),
drives(drive_id) AS (VALUES {", ".join(f"('{d}')" for d in DRIVES)}),
docs AS (SELECT doc_id, doc_id % 15 AS k, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS h1,
  sha256(coalesce(text, '') || '#2') AS h2, sha256(coalesce(text, '') || '#3') AS h3, strlen(coalesce(text, '')) AS size, {BASE_TIME} + doc_id AS at_time FROM documents),
fs AS (SELECT r.drive_id, doc_id, CASE WHEN moved THEN 'moved/' ELSE '' END || path AS path, CASE content WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END AS hash,
  CAST(CASE WHEN content = 1 THEN size ELSE size + 2 END AS BIGINT) AS size, CAST(CASE WHEN later IS NULL THEN 0 ELSE at_time + later END AS BIGINT) AS mtime,
  version_vector, tombstone, corrupted, CAST(NULL AS BIGINT) AS inode,
  coalesce(CAST(json_extract(version_vector, '$.drive_a') AS BIGINT), 0) AS a, coalesce(CAST(json_extract(version_vector, '$.drive_b') AS BIGINT), 0) AS b, coalesce(CAST(json_extract(version_vector, '$.drive_c') AS BIGINT), 0) AS c
  FROM docs JOIN rules r USING (k))"""
