"""SentencePiece encoding and decoding with a table of distinct chunks.

The model's normaliser is the identity with a dummy prefix, and none of its pieces has a white-space marker after
another character, so no merge crosses the start of a run of markers. A text is cut there; each distinct marked word
is segmented once by the library, and the ids are joined back by position with one gather. The table is kept within
a partition and emptied beyond ``TABLE`` entries, which bounds memory and changes no result.

A null text is empty and has the begin and end ids alone. Ids, nulls in ``doc_id`` and repeated rows are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

MARK = "▁"
TABLE = 100_000
_CHUNK = re.compile(" +[^ ]*")


class _Index(dict):
    """Chunk to row number; a new chunk gets the next number and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = i = len(self)
        self.fresh.append(chunk)
        return i


class ChunkTable:
    """Ids of distinct chunks, in one flat array with offsets."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.space, self.bos, self.eos = self.sp.piece_to_id(MARK), self.sp.bos_id(), self.sp.eos_id()
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat, self.at, self.pending = np.zeros(0, np.uint32), np.zeros(1, np.int64), []

    def _segment(self) -> None:
        fresh = self.index.fresh
        if fresh:
            made = self.sp.encode([c[1:] for c in fresh], num_threads=1)
            made = [[self.space] if c == " " else ids for c, ids in zip(fresh, made, strict=True)]
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in made for i in ids), np.uint32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
            fresh.clear()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids."""
        if len(self.index) > TABLE:
            self.clear()
        rows = []
        for text in texts:
            chunks = _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []
            rows.append(np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks)))
        self._segment()
        sizes = np.diff(self.at)
        out = []
        for row in rows:
            n = sizes[row]
            ids = np.empty(int(n.sum()) + 2, np.uint32)
            ids[0], ids[-1] = self.bos, self.eos
            if len(row):
                ids[1:-1] = self.flat[np.repeat(self.at[row] - (np.cumsum(n) - n), n) + np.arange(len(ids) - 2)]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def _groups(texts: pa.Array, size: int = 1 << 22) -> Iterator[list[str | None]]:
    held, n = [], 0
    for text in texts:
        held.append(text.as_py())
        n += len(held[-1] or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, keep: Column | None = None) -> DataFrame:
    """(doc_id, ids, decoded); with ``digests`` instead (doc_id, n_tokens, ids_sha256, decoded_sha256) of the same.

    With ``keep``, a column ``kept`` of its values follows.
    """
    import hashlib

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)
        for batch in batches:
            done = 0
            for texts in _groups(batch.column(1)):
                ids = table.encode(texts)
                doc, *more = (batch.column(i).slice(done, len(texts)) for i in range(batch.num_columns) if i != 1)
                done += len(texts)
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(table.decode(x).encode()).hexdigest() for x in ids]), *more],
                        names,
                    )
                else:
                    at = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                    yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))), pa.array([table.decode(x) for x in ids]), *more], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([] if keep is None else [keep.alias("kept")]))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    schema += "" if keep is None else f", kept {source.schema['kept'].dataType.simpleString()}"
    names = [c.split()[0] for c in schema.split(", ")]
    return source.mapInArrow(run, schema)
