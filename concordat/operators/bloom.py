"""Bloom filter membership. The filter is a table of set bits, so its size is bounded by no single machine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: FNV-1a with 64 bits, and the factor of the seed.
PRIME, OFFSET, SEED = 1099511628211, 14695981039346656037, 2654435761


def sizing(items: int, rate: float) -> tuple[int, int]:
    """(bits, hash functions) for a number of items and a false-positive rate."""
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    if items == 0:
        return 1, 1
    bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, int(bits / items * math.log(2) + 0.5))


def size_bytes(bits: int) -> int:
    return -(-bits // 8)


def hashes(items: list[bytes], count: int) -> np.ndarray:
    """FNV-1a of every item and seed; all items advance together, one byte a step."""
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    sizes = np.array([len(items[i]) for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    data = np.frombuffer(b"".join(items[i] for i in order), np.uint8)
    state = np.tile(np.uint64(OFFSET) ^ (np.arange(count, dtype=np.uint64) * np.uint64(SEED)), (len(items), 1))
    active = len(items)
    for step in range(int(sizes.max(initial=0))):
        while sizes[active - 1] <= step:
            active -= 1
        state[:active] = (state[:active] ^ data[starts[:active] + step].astype(np.uint64)[:, None]) * np.uint64(PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


def positions(items: DataFrame, column: str, bits: int, count: int) -> DataFrame:
    """(item, position): the distinct bits of each item; null counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            spots = (hashes([b or b"" for b in values.cast(pa.binary()).to_pylist()], count) % np.uint64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([values.take(pa.array(np.repeat(np.arange(len(values)), count))), pa.array(spots.reshape(-1))], ["item", "position"])

    return items.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("item")).mapInArrow(run, "item string, position long")


def insert(items: DataFrame, column: str, bits: int, count: int) -> DataFrame:
    """The filter: (position) of every set bit. The union of two filters of one size is their distinct union."""
    return positions(items, column, bits, count).select("position").distinct()


def might_contain(found: DataFrame, probes: DataFrame, column: str, bits: int, count: int) -> DataFrame:
    """(item, might_contain) for each distinct probe: all of its bits are set."""
    asked = positions(probes.select(column).distinct(), column, bits, count).distinct()
    hit = asked.join(found.withColumn("set", F.lit(1)), "position", "left")
    return hit.groupBy("item").agg((F.count("set") == F.count("*")).alias("might_contain"))
