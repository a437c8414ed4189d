"""Mixing sources to target weights by Pfair scheduling.

A source of integer weight a out of a total q owns a slots in every period of q. Its i-th block has the release time
floor(i q / a) and the deadline ceil((i + 1) q / a); earliest deadline first among the released blocks fills every
slot, and up to any slot each source is less than one block from its share. The schedule of one period depends on
the weights alone; block i of a source takes slot ``period * q + place`` with period = i div a, so no scheduling
runs over data. Slots of sources that have run out stay empty and the others go on in their proportions.

Within a source documents follow the MD5 of their id, which deals them into prefix buckets: ranks are counts of the
buckets before plus a rank inside the bucket, so a source with a third of all rows is still dealt over many tasks.
Sources without a weight, null included, share the stream ``rest``. A null id hashes as the empty text; rows with
the same id follow each other, ordered by a hash of the whole row. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

REST = "rest"
GROUP = 128
#: Slots of a period at most: the plan of one period is a broadcast of as many rows.
PERIOD = 100_000


def schedule(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(stream, block, slot, release, deadline) of one period: earliest deadline first among released blocks."""
    q = sum(weights.values())
    if not weights or min(weights.values()) < 1:
        raise ValueError("weights are positive integers")
    if q > PERIOD:
        raise ValueError(f"weights sum to over {PERIOD}")
    releases: list[list[str]] = [[] for _ in range(q)]
    for name, a in weights.items():
        for i in range(a):
            releases[i * q // a].append((-(-(i + 1) * q // a), name, i, i * q // a))
    ready: list[tuple] = []
    out = []
    for slot in range(q):
        for item in releases[slot]:
            heapq.heappush(ready, item)
        deadline, name, i, release = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append((name, i, slot, release, deadline))
    return out


def ranked(docs: DataFrame, stream: Column, order: Column, tie: Column, payload: list[Column], digits: int = 3) -> DataFrame:
    """Adds ``stream`` and ``rank`` (from 0 within the stream), without a task per stream."""
    rows = docs.select(*payload, stream.alias("stream"), order.alias("_order"), tie.alias("_tie")).withColumn("_bucket", F.substring("_order", 1, digits))
    sizes = rows.groupBy("stream", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("stream").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("stream", "_bucket").orderBy("_order", "_tie")
    found = rows.withColumn("_r", F.row_number().over(inside)).join(offsets, ["stream", "_bucket"])
    return found.withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_bucket", "_before", "_r", "_order", "_tie")


def mix(docs: DataFrame, weights: dict[str, int], block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, stream, block, slot, release, deadline, position, row_hash).

    ``position`` numbers all documents from 0 in the mixed order; ``row_hash`` is a hash of all columns of the row.
    """
    spark = docs.sparkSession
    period = schedule(weights if REST in weights else {**weights, REST: 1})
    q = len(period)  # at most PERIOD, so are the two broadcasts below
    sizes = Counter(p[0] for p in period)
    columns = [list(c) for c in zip(*[(*p, sizes[p[0]]) for p in period], strict=True)]
    plan = spark.createDataFrame(pa.table(columns, ["stream", "place", "at", "first", "last", "a"]))  # a constant of the plan
    source = F.col(source_col).cast("string")
    doc = F.col(id_col).cast("long")
    stream = F.when(source.isin([w for w in weights if w != REST]), source).otherwise(F.lit(REST))
    order = F.md5(F.coalesce(doc.cast("string"), F.lit("")).cast("binary"))
    whole = F.xxhash64(*[docs[c] for c in docs.columns])
    payload = [doc.alias("doc_id"), source.alias("source"), whole.alias("row_hash")]
    tie = F.struct(doc.alias("d"), whole.alias("h"))
    rows = ranked(docs, stream, order, tie, payload)
    rows = rows.withColumn("block", F.floor(F.col("rank") / block_docs)).withColumn("_in", F.col("rank") % block_docs)
    shares = F.broadcast(plan.select("stream", "a").distinct())  # as many rows as weights
    rows = rows.join(shares, "stream").withColumn("_period", F.expr("block div a")).withColumn("place", F.col("block") % F.col("a"))
    rows = rows.join(F.broadcast(plan.drop("a")), ["stream", "place"])  # as many rows as the weights sum to
    base = F.col("_period") * q
    rows = rows.select("doc_id", "source", "stream", "block", (base + F.col("at")).alias("slot"), (base + F.col("first")).alias("release"), (base + F.col("last")).alias("deadline"), "_in", "row_hash")
    # Written once: the counts of the groups and the ranks inside them both read it.
    rows, _ = Scratch(spark).write(rows.withColumn("_group", F.expr(f"slot div {GROUP}")).withColumn("_far", F.expr(f"slot div {GROUP * GROUP * 8}")))
    # Counts add up in two levels: over the groups of a stretch of slots, and over the stretches.
    sizes = rows.groupBy("_far", "_group").agg(F.count("*").alias("_n"))
    near = Window.partitionBy("_far").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    wide = Window.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)  # a row for over 130,000 slots
    stretches = sizes.groupBy("_far").agg(F.sum("_n").alias("_n")).select("_far", F.coalesce(F.sum("_n").over(wide), F.lit(0)).alias("_base"))
    offsets = sizes.withColumn("_near", F.coalesce(F.sum("_n").over(near), F.lit(0))).join(stretches, "_far").select("_group", (F.col("_near") + F.col("_base")).alias("_before"))
    inside = Window.partitionBy("_group").orderBy("slot", "_in")
    found = rows.withColumn("_r", F.row_number().over(inside)).join(offsets, "_group")
    return found.withColumn("position", F.col("_before") + F.col("_r") - 1).drop("_group", "_far", "_before", "_r", "_in")


def placed(docs: DataFrame, weights: dict[str, int], block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source", name: str = "position") -> DataFrame:
    """The rows of ``docs`` with their place in the mixed order in a last column ``name``, which ``docs`` must not have.

    Positions are found on narrow rows; texts meet them in one join and are not sorted, since no table keeps an order.
    """
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    places = mix(docs, weights, block_docs, id_col, source_col).select(F.coalesce("doc_id", F.lit(-1)).alias("_key"), F.col("row_hash").alias("_hash"), "position")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_key"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("_hash"))
    whole = whole.dropDuplicates(["_key", "_hash"])  # a repeated row has as many places
    return whole.join(places, ["_key", "_hash"]).select("row.*", F.col("position").alias(name))
