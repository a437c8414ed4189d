"""Content-defined chunks of whole blobs, and the chunks that a new version needs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The polynomial of the fingerprint, sizes in bytes.
POLYNOMIAL = 0xBFE6B8A5BF378D83
MIN_SIZE, AVG_SIZE, MAX_SIZE, THRESHOLD = 16 * 1024, 64 * 1024, 256 * 1024, 1024 * 1024
#: Blobs over LONG bytes are cut one at a time, at most a block of BLOCK bytes (or four of the longest chunks) in memory.
LONG, BLOCK = 64 * 1024, 4 << 20


def fingerprint_table() -> np.ndarray:
    """What each byte value becomes after eight shifts of the reflected polynomial."""
    value = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        value = np.where(value & np.uint64(1), (value >> np.uint64(1)) ^ np.uint64(POLYNOMIAL), value >> np.uint64(1))
    return value


def _apply(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear map of 64-bit states, given as what each value of each of their bytes becomes."""
    parts = np.ascontiguousarray(states, "<u8").view(np.uint8).reshape(-1, 8)
    out = tables[0][parts[:, 0]]
    for i in range(1, 8):
        out ^= tables[i][parts[:, i]]
    return out


@cache
def _zeros(power: int) -> np.ndarray:
    """The map that takes a state past 2**power zero bytes."""
    if power:
        half = _zeros(power - 1)
        return _apply(half, half.ravel()).reshape(8, 256)
    unit = np.arange(256, dtype=np.uint64) << (8 * np.arange(8, dtype=np.uint64))[:, None]
    return (unit >> np.uint64(8)) ^ fingerprint_table()[unit.astype(np.uint8)]


def _prefixes(data: np.ndarray) -> np.ndarray:
    """The fingerprint after each byte, by lanes of about the square root of the bytes: each from zero, then joined."""
    table, eight = fingerprint_table(), np.uint64(8)
    power = max(0, (len(data) - 1).bit_length() // 2)
    width = 1 << power
    lanes = -(-len(data) // width)
    columns = np.ascontiguousarray(np.pad(data, (0, lanes * width - len(data))).reshape(lanes, width).T)
    out, fp = np.empty((width, lanes), np.uint64), np.zeros(lanes, np.uint64)
    for j in range(width):
        fp = (fp >> eight) ^ table[fp.astype(np.uint8) ^ columns[j]]
        out[j] = fp
    start, skip = np.zeros(lanes, np.uint64), _zeros(power)
    for k in range(1, lanes):
        start[k : k + 1] = _apply(skip, start[k - 1 : k]) ^ fp[k - 1]
    for j in range(width):
        start = (start >> eight) ^ table[start.astype(np.uint8)]
        out[j] ^= start
    return out.T.ravel()[: len(data)]


def _first_cut(state: np.ndarray, at: int, least: int, mask: int, most: int) -> int | None:
    """Length of the chunk that starts at ``at``, None if the data end before a cut.

    The fingerprint is linear: that of a stretch is the prefix at its end, less the prefix at its start taken past
    the stretch's length in zero bytes.
    """
    least, left = max(least, 1), min(most, len(state) - at)
    past = state[at - 1 : at] if at else np.zeros(1, np.uint64)
    for power in range(least.bit_length()):
        if least >> power & 1:
            past = _apply(_zeros(power), past)
    ends, seen = state[at + least - 1 : at + left], 0
    while seen < len(ends):
        past = past[: len(ends)]
        hits = np.flatnonzero(((ends[seen : len(past)] ^ past[seen:]) & np.uint64(mask)) == 0)
        if len(hits):
            return least + seen + int(hits[0])
        seen = len(past)
        if seen < len(ends):
            past = np.concatenate((past, _apply(_zeros(seen.bit_length() - 1), past)))
    return most if left == most else None


def long_cuts(blob: bytes, least: int, mask: int, most: int, block: int = BLOCK) -> list[int]:
    """Ends of the chunks of one long blob, a block at a time; a block starts where the last chunk ended."""
    data, found, start = np.frombuffer(blob, np.uint8), [], 0
    while start < len(data):
        state = _prefixes(data[start : start + max(block, 4 * most)])
        at, last = 0, start + len(state) == len(data)
        while at < len(state) and (last or len(state) - at >= most):
            at += _first_cut(state, at, least, mask, most) or len(state) - at
            found.append(start + at)
        start += at
    return found


def cuts(blobs: list[bytes], least: int, mask: int, most: int, long: int = LONG) -> list[list[int]]:
    """Ends of the chunks of each blob. Short blobs advance together, one byte a step, so a step is one array operation."""
    out: list[list[int]] = [[] for _ in blobs]
    short = [i for i, b in enumerate(blobs) if len(b) <= long]
    for i, ends in zip(short, _short_cuts([blobs[i] for i in short], least, mask, most), strict=True):
        out[i] = ends
    for i, blob in enumerate(blobs):
        if len(blob) > long:
            out[i] = long_cuts(blob, least, mask, most)
    return out


def _short_cuts(blobs: list[bytes], least: int, mask: int, most: int) -> list[list[int]]:
    if not blobs:
        return []
    table = fingerprint_table()
    by_size = sorted(range(len(blobs)), key=lambda i: -len(blobs[i]))
    sizes = np.array([len(blobs[i]) for i in by_size], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    data = np.frombuffer(b"".join(blobs[i] for i in by_size), np.uint8)
    print_, since = np.zeros(len(blobs), np.uint64), np.zeros(len(blobs), np.int64)
    found: list[list[int]] = [[] for _ in blobs]
    active = len(blobs)
    for step in range(int(sizes.max(initial=0))):
        while sizes[active - 1] <= step:
            active -= 1
        fp = print_[:active]
        byte = data[starts[:active] + step]
        fp = (fp >> np.uint64(8)) ^ table[(fp ^ byte).astype(np.uint8)]
        since[:active] += 1
        length = since[:active]
        end = ((length >= least) & ((fp & np.uint64(mask)) == 0)) | (length >= most)
        print_[:active] = np.where(end, np.uint64(0), fp)
        if end.any():
            for row in np.flatnonzero(end):
                found[by_size[row]].append(step + 1)
            since[:active][end] = 0
    for i, blob in enumerate(blobs):
        if len(blob) and (not found[i] or found[i][-1] < len(blob)):
            found[i].append(len(blob))
    return found


def chunk(blobs: DataFrame, id_col: str, content: Column, average: int = AVG_SIZE, least: int = MIN_SIZE, most: int = MAX_SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """(id, offset, size, hash) rows; a blob of up to ``threshold`` bytes, empty ones too, is a single chunk."""
    if not least <= average <= most:
        raise ValueError("the average size must lie between the least and the most")
    mask = (1 << (average - 1).bit_length()) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = batch.column(0), [b or b"" for b in batch.column(1).to_pylist()]
            large = [i for i, b in enumerate(bodies) if len(b) > threshold]
            ends: list[list[int]] = [[len(b)] for b in bodies]
            for i, found in zip(large, cuts([bodies[i] for i in large], least, mask, most), strict=True):
                ends[i] = found
            rows = [(i, a, b - a, hashlib.sha256(bodies[i][a:b]).hexdigest()) for i, es in enumerate(ends) for a, b in zip([0, *es[:-1]], es, strict=True)]
            c = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([names.take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], ["id", "offset", "size", "hash"])

    return blobs.select(F.col(id_col).alias("id"), content.cast("binary").alias("content")).mapInArrow(run, f"id {blobs.schema[id_col].dataType.simpleString()}, offset long, size long, hash string")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of ``new`` whose hash ``old`` lacks, repeats included."""
    return new.join(old.select("hash"), "hash", "left_anti").select(*new.columns)
