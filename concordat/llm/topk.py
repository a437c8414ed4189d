"""Exact top-k search by tiled matrix products.

Vectors become integers floor(256 x); candidates are packed into shards and the stated queries into tiles, written
once. Shards are dealt into rows and tiles into columns of a grid; a cell holds a copy of its row's shards and of its
column's tiles and is one task's work: every tile meets every shard in exactly one cell, by an equi-join on the cell.
The grid has as many cells as there are shuffle partitions (no more than there are products) and the shape that
copies the least. A product ends in a partial selection; a task merges the lists of its tiles, salted groups of tasks
merge theirs, and a last merge leaves k for each query. Scores are exact: a product runs in float64 only while every
sum stays below 2**53, otherwise in Python integers; beyond a long they are its bounds.

Vectors that are null, or hold a null or a non-finite component, and rows with a null id take no part, neither as
query nor as candidate. Vectors of different length have no inner product and do not meet. A query's own id is no
candidate, in repeated rows either; a repeated query row is answered once for each distinct vector it has. Ties go
to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, partitions

SHARD, TILE = 4096, 512
#: Components of a block at most (8 bytes each), unless one vector has more.
BLOCK = 1 << 20
PACKED = "block long, dim int, ids binary, data binary"


def _pack(rows: int):
    """Arrow rows (id, vector) to blocks of at most ``rows`` vectors of one length, ids ascending, over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            """Full blocks of ``dim``, or with ``least`` 1 all that is held."""
            full = max(1, min(rows, BLOCK // max(dim, 1)))
            if count.get(dim, 0) < max(least, 1 if least == 1 else full):
                return
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            end = len(ids) if least == 1 else len(ids) // full * full
            for at in range(0, end, full):
                order = at + np.argsort(ids[at : min(at + full, end)], kind="stable")
                name = xxhash.xxh64_intdigest(ids[order].tobytes(), len(order)) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([data[order].tobytes()])], ["block", "dim", "ids", "data"])
            held[dim], count[dim] = [(ids[end:], data[end:])], len(ids) - end

        for batch in batches:
            ids, vectors = np.asarray(batch.column(0)).astype(np.int64), batch.column(1)
            sizes = np.asarray(vectors.value_lengths())
            flat, ends = np.asarray(vectors.flatten()), np.cumsum(sizes)
            for dim in map(int, np.unique(sizes)):
                mine = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[mine], flat[(ends[mine] - dim)[:, None] + np.arange(dim)].astype(np.int64)))
                count[dim] = count.get(dim, 0) + len(mine)
                yield from blocks(dim, 0)
        for dim in list(held):
            yield from blocks(dim, 1)

    return run


def grid(shards: int, tiles: int, cells: int) -> tuple[int, int]:
    """Rows and columns of at most ``cells`` cells with the fewest copies: columns a shard, rows a tile."""
    cells = max(1, min(cells, shards * tiles))
    shapes = [(max(1, min(shards, cells // c)), c) for c in range(1, min(tiles, cells) + 1)]
    whole = max((r * c for r, c in shapes), default=1)
    return min((x for x in shapes if 2 * x[0] * x[1] > whole), key=lambda x: shards * x[1] + tiles * x[0], default=(1, 1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers."""
    top = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(exact, -(1 << 63)), (1 << 63) - 1).astype(np.int64)


def best(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, scores) of the k best of a shard whose ids ascend."""
    scores = _products(queries, shard)
    for row in range(len(queries)):
        line, names = scores[row], ids
        if (own := ids == query_ids[row]).any():
            line, names = line[~own], ids[~own]
        if len(line) > k:
            least = np.partition(line, len(line) - k)[len(line) - k]
            over, tied = np.flatnonzero(line > least), np.flatnonzero(line == least)
            pick = np.concatenate([over, tied[: k - len(over)]])
        else:
            pick = np.arange(len(line))
        pick = sorted(pick, key=lambda i: (-line[i], names[i]))[:k]
        yield row, names[pick], np.array([int(x) for x in line[pick]], np.int64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_ids, q_data, ids, data = (batch.column(i)[row].as_py() for i in range(5))
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                queries, shard = np.frombuffer(q_data, np.int64).reshape(len(q_ids), dim), np.frombuffer(data, np.int64).reshape(len(ids), dim)
                for i, names, scores in best(queries, q_ids, shard, ids, k):
                    key = (int(q_ids[i]), queries[i].tobytes())
                    held = lists.get(key, []) + [(-int(s), int(n)) for s, n in zip(scores, names, strict=True)]
                    lists[key] = sorted(held)[:k]
            if len(lists) > 50_000:
                yield _rows(lists)
                lists.clear()
        if lists:
            yield _rows(lists)

    return run


def _rows(lists: dict) -> pa.RecordBatch:
    flat = [(q, hash_of(v), n, -s) for (q, v), held in lists.items() for s, n in held]
    columns = list(zip(*flat, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_key", "vec_id", "score"])


def hash_of(vector: bytes) -> int:
    return xxhash.xxh64_intdigest(vector) - (1 << 63)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query."""
    spark = vectors.sparkSession
    bound_batches(spark)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, whole).alias("v"), is_query.alias("q")).filter("vec_id is not null and v is not null")
    scratch = Scratch(spark)
    shards, _, some = scratch.measured(rows.select("vec_id", "v").mapInArrow(_pack(SHARD), PACKED))
    tiles, _, asked = scratch.measured(rows.filter("q").select("vec_id", "v").distinct().mapInArrow(_pack(TILE), PACKED))
    down, across = grid(some["n"], asked["n"], partitions(spark))
    cell, cells = ["dim", "down", "across"], down * across
    part = lambda n: F.pmod(F.col("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = shards.select("dim", part(down).alias("down"), every(across).alias("across"), "ids", "data").repartition(cells, *cell)
    tiles = tiles.select("dim", every(down).alias("down"), part(across).alias("across"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).repartition(cells, *cell)
    met = shards.join(tiles, cell).select("dim", "q_ids", "q_data", "ids", "data")
    found = met.mapInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    salted = Window.partitionBy("query_id", "query_key", "salt").orderBy(*order)
    part = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(8))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
    last = Window.partitionBy("query_id", "query_key").orderBy(*order)
    return part.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
