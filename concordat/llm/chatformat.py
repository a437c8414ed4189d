"""Chat formatting by columnar byte assembly.

Turns of a conversation, in the order of their turn number, become one formatted text: each turn is a header, the
escaped text and a footer. A header or footer starts with ``<`` or ``[``; those two characters and the backslash are
escaped by a backslash inside texts and roles, so no text can pass for a control string and unescaping is exact.
Segment lengths, their cumulative offsets and scatter indices come from numpy; headers and contents are copied into
one preallocated buffer that becomes the Arrow column. The loss spans are the assistant texts alone.

A null text or role is empty. Rows of the same turn number are ordered by role and text, nulls first; repeated rows
are repeated turns. Rows with a null conversation id form one conversation with a null id. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: The template, as role: (header, footer). Any other role is named in its header.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n")}
OTHER = ("<|", "|>", "<|end|>\n")
LEARNED = "assistant"
CHUNK = 1 << 22
SLICE = 1 << 26
SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())])))])


def escape(texts: pa.Array) -> pa.Array:
    """Nulls become empty; a backslash goes before each backslash, ``<`` and ``[``."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, r"[\\<\[]")).as_py():
        texts = pc.replace_substring_regex(texts, r"([\\<\[])", r"\\\1")
    return texts


def unescape(text: str) -> str:
    return text if "\\" not in text else re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and n + 1 offsets of a binary array without nulls."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def scatter(out: np.ndarray, dest: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies data[start[i]:start[i]+length[i]] to out[dest[i]:], a bounded number of indices at a time."""
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        base = ends[at] - length[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        if to == at + 1:
            out[dest[at] : dest[at] + length[at]] = data[start[at] : start[at] + length[at]]
        else:
            n = length[at:to]
            step = np.arange(n.sum()) - np.repeat(ends[at:to] - n - base, n)
            out[np.repeat(dest[at:to], n) + step] = data[np.repeat(start[at:to], n) + step]
        at = to


def assemble(conv_ids: pa.Array, turns: pa.Array) -> pa.RecordBatch:
    """One formatted text for each list of (turn, role, text)."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(turns), 0)).astype(np.int64)
    flat = pc.list_flatten(turns)
    role, text = flat.field("role"), escape(flat.field("text"))
    names = pc.fill_null(role, "").dictionary_encode()
    headers, footers = [], []
    for name in names.dictionary.to_pylist():
        other = escape(pa.array([name]))[0].as_py().replace("|", "\\|")
        head, foot = TEMPLATE.get(name, (OTHER[0] + other + OTHER[1], OTHER[2]))
        headers.append(head.encode())
        footers.append(foot.encode())
    code = np.asarray(names.indices).astype(np.int64)
    body, body_at = _bytes(text)
    parts = [_bytes(pa.array(headers, pa.binary())), (body, body_at), _bytes(pa.array(footers, pa.binary()))]
    picks = [code, np.arange(len(flat)), code]
    lengths = np.stack([np.diff(p[1])[i] for p, i in zip(parts, picks, strict=True)], axis=1) if len(flat) else np.zeros((0, 3), np.int64)
    ends = np.cumsum(lengths.reshape(-1))
    starts = (ends - lengths.reshape(-1)).reshape(-1, 3)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, ((data, at), pick) in enumerate(zip(parts, picks, strict=True)):
        scatter(out, starts[:, k], data, at[:-1][pick], lengths[:, k])
    turn_end = np.concatenate(([0], np.cumsum(counts)))
    text_end = np.concatenate(([0], ends[2::3])) if len(flat) else np.zeros(1, np.int64)
    offsets = text_end[turn_end]
    formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.large_string()).cast(pa.string())
    learned = np.asarray(pc.fill_null(pc.equal(role, LEARNED), False)).astype(bool)
    owner = np.repeat(np.arange(len(counts)), counts)[learned]
    spans = pa.StructArray.from_arrays([pa.array(starts[learned, 1] - offsets[owner]), pa.array(lengths[learned, 1])], ["start", "len"])
    span_at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(counts)))))
    return pa.RecordBatch.from_arrays([conv_ids, formatted, pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans)], schema=SCHEMA)


def slices(turns: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of conversations with about ``size`` bytes of text, 500 at most; a larger one stands alone."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(turns), 0)).astype(np.int64)
    text = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(pc.list_flatten(turns).field("text")), 0)))))
    ends = text[np.cumsum(counts)] if len(counts) else counts
    at = 0
    while at < len(counts):
        base = ends[at - 1] if at else 0
        to = min(at + 500, max(at + 1, int(np.searchsorted(ends, base + size, "right"))))
        yield at, to
        at = to


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are byte offsets and lengths in the UTF-8 of ``formatted``."""
    bound_batches(rows.sparkSession)
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    grouped = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                yield assemble(part.column(0), part.column(1))

    return grouped.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, len: long>>")


#: A header, and a text up to its footer. Runs never give back what they took, so both are linear and keep no stack;
#: the blank before ``[/INST]`` is taken with the text.
_HEAD = re.compile(r"<<SYS>>|\[INST\] |<s>|<\|((?:[^\\|]++|\\.)*+)\|>", re.DOTALL)
_TEXT = re.compile(r"((?:[^\\<\[]++|\\.)*+)(<</SYS>>\n|\[/INST\]\n|</s>\n|<\|end\|>\n)", re.DOTALL)
_ROLES = {head: role for role, (head, _) in TEMPLATE.items()}


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted text."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        body = head and _TEXT.match(formatted, head.end())
        if not body:
            raise ValueError(f"not a turn at {at}")
        role = _ROLES.get(head[0])
        text = body[1]
        if (OTHER[2] if role is None else TEMPLATE[role][1].lstrip(" ")) != body[2] or role == "user" and not text.endswith(" "):
            raise ValueError(f"a footer of another role at {at}")
        out.append((unescape(head[1]) if role is None else role, unescape(text[:-1] if role == "user" else text)))
        at = body.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted text and its loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns, raw = parse(r["formatted"]), r["formatted"].encode()
                learned = "".join(unescape(raw[s["start"] : s["start"] + s["len"]].decode()) for s in r["loss_spans"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(r["formatted"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
