"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id goes.

1. Winnowing deals out the work. The anchor of a window of ``length`` bytes is the smallest hash of its substrings
   of ``ANCHOR`` bytes, so equal windows have equal anchors wherever they stand. A piece is a run of windows with
   one anchor. Map tasks report (anchor, text) for each block of rows; a reducer of an anchor range tells the texts
   of every anchor that more than one text has. Windows of other anchors stand in one text only.
2. Rows of one text lie together. Of those whose bytes are the same the smallest id of a block stands for all, and
   the others lose everything on the spot. It sends the bytes of its pieces with shared anchors (of all its pieces,
   if the text has copies) to the shard of the anchor. A shard concatenates its
   pieces and builds a suffix array in two stages: only suffixes smaller than their successors are sorted directly,
   the others are induced by scanning the buckets in order. Common prefixes of neighbours of at least ``length``
   bytes mark equal windows; every occurrence in a document above the smallest id is a removal. A piece whose very
   bytes the block has in a smaller id need not travel: it is a removal on the spot.
3. Intervals are merged per text and id and cut out.

So hashes say which windows meet; that they are equal is decided by their bytes alone.

Hot anchors: a block with over ``CROWD`` rows of one anchor reports the anchor as crowded and its rows apart, and so
does a reducer that sees over ``CROWD * 8``; the windows of crowded anchors travel one by one to the shard of the
window's hash, smallest id per block first. Nothing is dropped, capped or sampled.

Null text is empty. Ids rank documents; rows with the same id are one document and never remove from each other, and a
null id ranks after all others. Texts are known by 128 bits, rows by these and the id, so many rows of one id, or
without one, make no group, and all copies of a text share one entry. Documents shorter than ``length`` keep everything. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions

ANCHOR = 24
BLOCK = 1 << 23
CROWD = 128
MAX_WINDOWS = 512
SHARD_BYTES = 1 << 20
STRETCH = 1 << 20
LAST_ID = (1 << 63) - 1
#: Kinds of packed rows: pairs to judge or pieces to sort; rows that pass; anchors that are crowded.
WORK, PASS, MARK = 0, 1, 2
U = np.uint64
_K = [U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _K[3]
    x = (x ^ (x >> U(29))) * _K[4]
    return x ^ (x >> U(32))


def substring_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every substring of ``size`` bytes, put together from hashes of doubling lengths."""
    power = (data.astype(np.uint64) + U(1)) * _K[0]
    power ^= power >> U(29)
    out, at, width, n = None, 0, 1, len(data) - size + 1
    while True:
        if size & width:
            part = power[at : at + n]
            out = part.copy() if out is None else out * _K[2] + part
            at += width
        if width * 2 > size:
            return mixed(out)
        power = power[:-width] * _K[1] + power[width:]
        power ^= power >> U(31)
        width *= 2


def window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def pieces(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, windows) of the runs of windows with one anchor, a stretch of the text at a time."""
    if len(data) < STRETCH + length:
        return _stretch(data, length)
    parts = []
    for at in range(0, len(data) - length + 1, STRETCH):
        low, start, size = _stretch(data[at : at + STRETCH + length - 1], length)
        parts.append((low, start + at, size))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _stretch(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one stretch; runs over MAX_WINDOWS are cut."""
    anchor = min(ANCHOR, length)
    low = window_minimum(substring_hashes(data, anchor), length - anchor + 1)
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.append(start, len(low)))
    if size.max() > MAX_WINDOWS:
        cuts = -(-size // MAX_WINDOWS)
        first = np.repeat(np.cumsum(cuts) - cuts, cuts)
        step = np.arange(cuts.sum()) - first
        start, end = np.repeat(start, cuts) + step * MAX_WINDOWS, np.repeat(start + size, cuts)
        size = np.minimum(MAX_WINDOWS, end - start)
    return mixed(low[start]), start, size  # minima crowd near 0, so anchors are mixed once more


def shrink(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def grow(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns one after the other, the first as differences, bytes of one place together: so they compress."""
    first = np.diff(columns[0].view(np.uint64), prepend=U(0))
    return shrink(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in (first, *columns[1:])))


def unpack(data: bytes, count: int) -> list[np.ndarray]:
    out = [np.ascontiguousarray(c.reshape(8, -1).T).view(np.uint64).reshape(-1) for c in np.frombuffer(grow(data), np.uint8).reshape(count, -1)]
    return [np.cumsum(out[0]), *out[1:]]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[list[tuple]]:
    """Lists of rows with about ``size`` bytes of text (column 1)."""
    held, n = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        texts = columns[1].cast(pa.binary())
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            held.append((columns[0][i].as_py(), text, *(c[i] for c in columns[2:])))
            n += len(text)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _homes(deal: np.ndarray, order: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(home, places) of 64-bit values dealt into ``count`` ranges, so that neighbours differ little; by ``order`` inside."""
    home = (((deal >> U(32)) * U(count)) >> U(32)).astype(np.int64)
    by = np.lexsort((order, home))
    begin = np.flatnonzero(firsts(home[by]))
    for b, e in zip(begin, [*begin[1:], len(by)], strict=False):
        yield int(home[by[b]]), by[b:e]


def _report(length: int, buckets: int):
    """Stage 1, map side: (bucket, kind, units, data) for each block of (mark, text)."""

    def packed(anchor: np.ndarray, who: np.ndarray, deal: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for home, at in _homes(deal, anchor, buckets):
            units, unit = np.unique(who[at], return_inverse=True)
            rows.append((home, kind, pack(units), pack(anchor[at], unit.astype(np.int64))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "units", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            found = [(who, np.unique(pieces(np.frombuffer(text, np.uint8), length)[0])) for who, text in rows if len(text) >= length]
            if not found:
                continue
            anchor = np.concatenate([a for _, a in found])
            who = np.repeat(np.array([w for w, _ in found], np.int64).view(np.uint64), [len(a) for _, a in found])
            order = np.lexsort((who, anchor))
            anchor, who = anchor[order], who[order]
            new = firsts(anchor, who)
            anchor, who = anchor[new], who[new]
            begin = np.flatnonzero(firsts(anchor))
            size = np.diff(np.append(begin, len(anchor)))
            many = np.repeat(size > CROWD, size)
            marks = anchor[begin[size > CROWD]]
            yield from packed(anchor[~many], who[~many], anchor[~many], WORK)
            yield from packed(marks, np.zeros_like(marks), marks, MARK)
            yield from packed(anchor[many], who[many], mixed(who[many]), PASS)

    return run


def _judge(table: pa.Table) -> pa.Table:
    """Stage 1, reducer of a bucket: (mark, anchor, split) for the shared anchors of each text."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORK: [], PASS: [], MARK: []}
    for kind, units, data in zip(*(table.column(c).to_pylist() for c in ("kind", "units", "data")), strict=True):
        anchor, unit = unpack(data, 2)
        held[kind].append((anchor, unpack(units, 1)[0][unit.astype(np.int64)]))
    none = [np.zeros(0, np.uint64)]
    anchor, who = (np.concatenate([x[i] for x in held[WORK]] or none) for i in (0, 1))
    order = np.lexsort((who, anchor))
    anchor, who = anchor[order], who[order]
    new = firsts(anchor, who)  # a text may stand in several blocks
    anchor, who = anchor[new], who[new]
    begin = np.flatnonzero(firsts(anchor))
    size = np.repeat(np.diff(np.append(begin, len(anchor))), np.diff(np.append(begin, len(anchor))))
    crowded = (size > 8 * CROWD) | np.isin(anchor, np.concatenate([x[0] for x in held[MARK]] or none))
    told = crowded | (size > 1)
    passed = [np.concatenate([x[i] for x in held[PASS]] or none) for i in (0, 1)]
    split = np.concatenate((crowded[told], np.ones(len(passed[0]), bool)))
    return pa.table({"mark": np.concatenate((who[told], passed[1])).view(np.int64), "anchor": np.concatenate((anchor[told], passed[0])).view(np.int64), "split": split})


def _send(length: int, shards: int):
    """Stage 2, map side: (shard, kind, units, data, body): pieces with shared anchors, and windows if crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            units: list[tuple[int, int, int]] = []
            sent: list[tuple[int, int, int, bytes]] = []
            done: list[tuple[int, int, int]] = []
            seen: dict[bytes, int] = {}

            def put(order: int, start: int, body: bytes) -> None:
                """Sends the last unit's bytes, unless the block has them in a smaller id."""
                unit = len(units) - 1
                at = seen.get(body)
                if at is not None:
                    first = sent[at]
                    if units[first[1]][1] < units[unit][1]:
                        done.append((unit, start, start + len(body)))
                        return
                    if units[first[1]][1] > units[unit][1]:
                        done.append((first[1], first[2], first[2] + len(body)))
                        sent[at] = (order, unit, start, body)
                        return
                else:
                    seen[body] = len(sent)
                sent.append((order, unit, start, body))

            first: dict[bytes, tuple] = {}  # the smallest id of each text of the block
            rules: set[tuple[int, int, int]] = set()
            for mark, text, doc, wide, send, split, copied in rows:
                if len(text) < length or not (send.is_valid and len(send) or split.is_valid and len(split) or copied.is_valid and copied.as_py()):
                    continue
                mine = (mark, doc.as_py() if doc.is_valid else LAST_ID, wide.as_py(), send, split, copied)
                held = first.setdefault(text, mine)
                if held[1] != mine[1]:
                    first[text] = min(held, mine, key=lambda x: x[1])
                    rules.add((mark, first[text][1], mine[2]))
            for text, (mark, doc, wide, send, split, copied) in first.items():
                units.append((mark, doc, wide))
                anchor, start, size = pieces(np.frombuffer(text, np.uint8), length)
                within = lambda x: np.isin(anchor, np.asarray(x.values).view(np.uint64)) if x.is_valid and len(x) else np.zeros(len(anchor), bool)  # noqa: B023, E731
                apart = within(split)
                whole = ~apart if copied.is_valid and copied.as_py() else within(send)
                for i in np.flatnonzero(whole):
                    put(int(anchor[i]), int(start[i]), text[start[i] : start[i] + size[i] + length - 1])
                for i in np.flatnonzero(apart):
                    for at in range(start[i], start[i] + size[i]):
                        window = text[at : at + length]
                        put(xxhash.xxh64_intdigest(window), int(at), window)
            for mark, doc, wide in rules:  # larger ids of this text lose all of it
                units.append((mark, doc, wide))
                done.append((len(units) - 1, -1, -1))
            out = []
            every = np.array(units, np.int64).reshape(-1, 3)
            if sent:
                order = np.array([x[0] for x in sent], np.uint64)
                unit, start = (np.array([x[i] for x in sent], np.int64) for i in (1, 2))
                for home, at in _homes(mixed(order), order, shards):
                    used, index = np.unique(unit[at], return_inverse=True)
                    body = [sent[i][3] for i in at]
                    out.append((home, WORK, pack(*every[used].T), pack(order[at], index.astype(np.int64), start[at], np.array([len(b) for b in body])), shrink(b"".join(body))))
            if done:
                unit, start, end = np.array(done, np.int64).T
                who = every[unit, 0].view(np.uint64)
                for home, at in _homes(mixed(who), start, shards):
                    used, index = np.unique(unit[at], return_inverse=True)
                    out.append((home, PASS, pack(*every[used].T), pack(start[at], index.astype(np.int64), end[at]), b""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "kind", "units", "data", "body"])

    return run


def suffix_array(text: np.ndarray, depth: int, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Two-stage suffix array of the bytes ``text``, exact to ``depth`` bytes.

    A suffix smaller than its successor (type B) is sorted directly by its first bytes; one that is not (type A)
    stands before all of type B in the bucket of its first byte, in the order of its successor, so a scan of the
    buckets from the smallest puts it in place. The end of the text is smaller than any byte.

    With ``first`` and ``last`` (ascending, apart), only suffixes that start in these ranges are asked for; the
    array then holds them and the successors that their places follow from.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.flatnonzero(text[:-1] != text[1:])
    up = text[step] < text[step + 1]
    smaller = np.zeros(n, bool)
    run = np.diff(step, prepend=-1)
    smaller[: run.sum()] = np.repeat(up, run)
    need = np.ones(n, bool)
    if first is not None:
        type_b = np.append(np.flatnonzero(smaller), n - 1)
        reach = np.maximum(last, np.where(smaller[last - 1], last, type_b[np.searchsorted(type_b, last - 1)] + 1))
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, reach, -1)
        need = np.cumsum(edge[:-1]) > 0
    direct = np.flatnonzero(smaller & need)
    padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = [eights[direct + at].view(">u8").reshape(-1).astype(np.uint64) for at in range(0, depth, 8)]
    direct = direct[np.lexsort(words[::-1])]
    counts = np.bincount(text[need], minlength=256)
    begin = np.concatenate(([0], np.cumsum(counts)))
    out = np.full(begin[-1], -1, np.int64)
    head = text[direct]
    b_counts = np.bincount(head, minlength=256)
    out[begin[1:][head] - b_counts[head] + np.arange(len(direct)) - (np.cumsum(b_counts) - b_counts)[head]] = direct
    front = begin[:-1].copy()
    induced = need & ~smaller

    def induce(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[induced[before]]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        new = np.flatnonzero(firsts(symbol))
        size = np.diff(np.append(new, len(symbol)))
        out[front[symbol] + np.arange(len(symbol)) - np.repeat(new, size)] = before
        front[symbol[new]] += size

    induce(np.array([n]))
    for c in np.flatnonzero(counts):
        at = begin[c]
        while at < front[c]:  # runs of one byte induce within their own bucket
            to = front[c]
            induce(out[at:to])
            at = to
        induce(out[begin[c + 1] - b_counts[c] : begin[c + 1]])
    return out


def repeated(doc: np.ndarray, body: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window start in it) of every window that also stands in a piece of a smaller id.

    Pieces are set apart by a byte that UTF-8 never has; only windows inside one piece are looked at.
    """
    sizes = np.array([len(b) for b in body])
    text = np.frombuffer(b"\xff".join(body) + b"\xff", np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    array = suffix_array(text, length, begin, begin + sizes - length + 1)
    owner = np.repeat(np.arange(len(body), dtype=np.int32), sizes + 1)[array]
    whole = array + length <= (begin + sizes)[owner]
    array, owner = array[whole], owner[whole]
    common = common_prefixes(text, array, length)
    group = np.cumsum(common < length) - 1
    low = np.minimum.reduceat(doc[owner], np.flatnonzero(common < length))[group]
    hit = doc[owner] > low
    return owner[hit], (array - begin[owner])[hit]


def common_prefixes(text: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, that each suffix has in common with the one before it; 0 for the first."""
    rows = np.lib.stride_tricks.sliding_window_view(text, length)
    out = np.zeros(len(array), np.int64)
    for at in range(1, len(array), 1 << 16):
        to = min(len(array), at + (1 << 16))
        block = rows[array[at - 1 : to]]
        other = block[1:] != block[:-1]
        out[at:to] = np.where(other.any(axis=1), other.argmax(axis=1), length)
    return out


def _sort_shard(length: int):
    """Stage 2, reducer of a shard: (mark, doc, wide, a, b): intervals to remove, or -1 if larger ids lose all."""

    def run(table: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []  # mark, doc, wide, start, end of removals
        work: list[list[np.ndarray]] = []
        texts: list[bytes] = []
        for kind, units, data, body in zip(*(table.column(c).to_pylist() for c in ("kind", "units", "data", "body")), strict=True):
            unit = [x.view(np.int64) for x in unpack(units, 3)]
            if kind == PASS:
                a, index, b = (x.view(np.int64) for x in unpack(data, 3))
                found.append([*(u[index] for u in unit), a, b])
            else:
                order, index, a, size = unpack(data, 4)
                work.append([order, *(u[index.view(np.int64)] for u in unit), a.view(np.int64)])
                cuts = np.concatenate(([0], np.cumsum(size.view(np.int64)))).tolist()
                body = grow(body)
                texts += [body[b:e] for b, e in zip(cuts, cuts[1:], strict=False)]
        if work:
            order, mark, doc, wide, s = (np.concatenate(c) for c in zip(*work, strict=True))
            mine = np.argsort(order, kind="stable")
            order = order[mine]
            total, at = np.cumsum([len(texts[i]) for i in mine]), 0
            while at < len(mine):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SHARD_BYTES, "right")))
                to = int(np.searchsorted(order, order[to - 1], "right"))
                piece, step = repeated(doc[mine[at:to]], [texts[i] for i in mine[at:to]], length)
                piece = mine[at + piece]
                found.append([mark[piece], doc[piece], wide[piece], s[piece] + step, s[piece] + step + length])
                at = to
        mark, doc, wide, start, end = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        by = np.lexsort((start, doc, wide, mark))
        mark, doc, wide, start, end = mark[by], doc[by], wide[by], start[by], end[by]
        new = firsts(mark, doc, wide)
        group = np.cumsum(new) - 1
        reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # the farthest end so far in the row
        new[1:] |= (start[1:] > reach[:-1]) | (start[:-1] < 0)
        begin = np.flatnonzero(new)
        last = np.append(begin, len(start))[1:] - 1
        return pa.table({"mark": mark[begin], "doc": doc[begin], "wide": wide[begin], "a": start[begin], "b": reach[last]})

    return run


def cut(text: bytes, spans: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and the bytes that stay, of (n, 2) intervals."""
    if not len(spans):
        return [], text
    order = np.argsort(spans[:, 0], kind="stable")
    begin, reach = spans[order, 0], np.maximum.accumulate(spans[order, 1])
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    runs = list(zip(begin[first].tolist(), reach[np.append(first[1:], len(begin)) - 1].tolist(), strict=True))
    stays, at = [], 0
    for x, y in runs:
        stays.append(text[at:x])
        at = y
    return runs, b"".join([*stays, text[at:]])


def spans_of(size: int, doc: int, wide: int, entries: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """The (n, 2) intervals that a row of ``size`` bytes loses by the ``entries`` (doc, wide, a, b) of its mark."""
    docs, wides, a, b = entries
    mine = wides == wide
    if size >= length and (docs[mine & (a < 0)] < doc).any():
        return np.array([[0, size]])
    mine &= (docs == doc) & (a >= 0)
    return np.stack([a[mine], b[mine]], axis=1)


def _apply(length: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 2), np.int64)
        for rows in blocks(batches):
            out = []
            for doc, text, wide, *entries in rows:
                rank = LAST_ID if doc is None else doc
                spans = spans_of(len(text), rank, wide.as_py(), tuple(np.asarray(e.values) for e in entries), length) if entries[0].is_valid and len(entries[0]) else none
                runs, kept = cut(text, spans)
                out.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digests else kept, [x for x, _ in runs], [y for _, y in runs]))
            c = list(zip(*out, strict=True))
            arrays = [pa.array(x, pa.int64()) for x in c[:4]]
            if digests:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(c[4])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(c[4], pa.binary()), pa.array(c[5], pa.list_(pa.int64())), pa.array(c[6], pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "begins", "ends"])

    return run


def entries_of(spans: DataFrame) -> DataFrame:
    """(mark, docs, wides, a, b): one row a mark. Where larger ids lose all, nothing else is kept of them."""
    kept = spans.repartition("mark").groupBy("mark").agg(F.min("wide").alias("lo"), F.max("wide").alias("hi"), F.min(F.when(F.col("a") < 0, F.col("doc"))).alias("first"), F.collect_list(F.struct("doc", "wide", "a", "b")).alias("s"))
    rule = F.array(F.struct(F.col("first").alias("doc"), F.col("lo").alias("wide"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
    few = F.concat(rule, F.filter("s", lambda x: (x["a"] >= 0) & (x["doc"] <= F.col("first"))))
    kept = kept.select("mark", F.when((F.col("lo") == F.col("hi")) & F.col("first").isNotNull(), few).otherwise(F.col("s")).alias("s"))
    return kept.select("mark", *[F.col("s")[c].alias(n) for c, n in (("doc", "docs"), ("wide", "wides"), ("a", "a"), ("b", "b"))])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans) and kept bytes with the removed runs, or with ``digests`` their SHA-256."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.xxhash64(F.lit("wide"), "text").alias("wide"))
    reports = rows.select("mark", "text").mapInArrow(_report(length, partitions(spark)), "bucket int, kind int, units binary, data binary")
    verdicts = reports.groupBy("bucket").applyInArrow(_judge, "mark long, anchor long, split boolean")
    none = [F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("boolean").alias("split")]
    copies = rows.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark", *none)
    pick = lambda split: F.collect_list(F.when(F.col("split") == split, F.col("anchor")))
    # Dealt out as plain rows: lists of one or two would travel as rows three times as wide.
    by_text = verdicts.unionByName(copies).repartition("mark").groupBy("mark").agg(pick(False).alias("send"), pick(True).alias("split"), F.max(F.col("anchor").isNull()).alias("copied"))
    told = rows.join(by_text, "mark", "left")
    # Both joins take the same columns of ``rows`` by ``mark`` alone, so the texts are shuffled once.
    sent = told.select("mark", "text", "doc_id", "wide", "send", "split", "copied").mapInArrow(_send(length, partitions(spark, 2)), "shard int, kind int, units binary, data binary, body binary")
    spans = sent.groupBy("shard").applyInArrow(_sort_shard(length), "mark long, doc long, wide long, a long, b long")
    full = rows.join(entries_of(spans), "mark", "left").select("doc_id", "text", "wide", "docs", "wides", "a", "b")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "kept binary, begins array<long>, ends array<long>")
    return full.mapInArrow(_apply(length, digests), schema)
