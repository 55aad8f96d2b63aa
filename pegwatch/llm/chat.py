"""Chat formatting by columnar byte assembly, with a loss mask, and its reverse.

A turn is written as ``<s>[INST] role [/INST]text</s>``; turns of a conversation follow each other. The control strings ``<s>``, ``</s>``,
``[INST]`` and ``[/INST]`` inside roles and texts get a backslash after their first character, and those that already have
backslashes there get one more; taking one away restores the text. So an escaped text never holds a control string, and none can arise
where a text meets the template, as a control string's first character occurs in it only once.

Method: a batch of turns is assembled as columns. The lengths of all segments (headers, roles, texts, ends) are summed up to
offsets, and for each kind of segment one scatter index copies its bytes from the Arrow buffer into one preallocated buffer, which
becomes the Arrow column. Backslashes are set in the same way: one search over the whole buffer of a column, one copy. Loss spans
are the code points of the texts of the roles in ``loss_roles``, counted from the same buffer.

Turns are dealt by ranges of (conversation, turn) and sorted, so a conversation of any length is spread over tasks and batches and is never held
whole: each makes a segment (``seq`` orders them), and the conversation's text is its segments joined. Readers stream over
the segments in order.

Null roles and texts count as empty; rows with the same turn follow in the order of a hash of role and text, repeated rows are written as often as they occur; a null
turn comes first, rows with a null conversation form one conversation. Very long texts are copied whole; an empty table gives
an empty table. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.llm.common import ship_code, slices

OPEN, MIDDLE, CLOSE = b"<s>[INST] ", b" [/INST]", b"</s>"
CONTROL = re.compile(rb"<\\*/?s>|\[\\*/?INST\]")
ESCAPED = re.compile(rb"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])")
TURN = re.compile(rb"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
SEGMENTS = "conv_id long, seq long, text string, n_turns long, loss array<struct<start:long,end:long>>"


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column without nulls, and the offsets of its rows in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies row i of a column to place ``at[i]`` of the buffer."""
    sizes = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], sizes) + np.arange(len(data))] = data


def stamp(out: np.ndarray, at: np.ndarray, constant: bytes) -> None:
    """Copies a constant to all the places."""
    out[at[:, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column with a backslash after the first character of each control string; matches across two rows are none."""
    found = np.array([m.span() for m in CONTROL.finditer(data.tobytes())], np.int64).reshape(-1, 2)
    row = np.searchsorted(offsets, found[:, 0], "right")
    inside = found[:, 1] <= offsets[row] if len(found) else np.zeros(0, bool)
    places, row = found[inside, 0] + 1, row[inside]
    if not len(places):
        return data, offsets
    added = np.bincount(row - 1, minlength=len(offsets) - 1)
    return np.insert(data, places, ord("\\")), offsets + starts_of(added)


def unescape(text: bytes) -> bytes:
    return ESCAPED.sub(rb"\1\2\3\4", text) if b"\\" in text else text


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns, the offset at which each starts (and the end), and where its text starts and ends."""
    role, role_at = escape(*column_bytes(roles))
    text, text_at = escape(*column_bytes(texts))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    turn_at = starts_of(n_role + n_text + len(OPEN) + len(MIDDLE) + len(CLOSE))
    out = np.empty(turn_at[-1], np.uint8)
    middle = turn_at[:-1] + len(OPEN) + n_role
    begin = middle + len(MIDDLE)
    stamp(out, turn_at[:-1], OPEN)
    scatter(out, turn_at[:-1] + len(OPEN), role, role_at)
    stamp(out, middle, MIDDLE)
    scatter(out, begin, text, text_at)
    stamp(out, begin + n_text, CLOSE)
    return out, turn_at, begin, begin + n_text


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, seq, text, n_turns, loss (code points in ``text``): the segments of each conversation, one for most."""
    spark = conversations.sparkSession
    ship_code(spark)
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # equal rows fall into one range, so ranges follow each other in the order of the rows
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), keys[0], keys[1], F.xxhash64("role", "text")).sortWithinPartitions(keys[0], keys[1], F.xxhash64("role", "text"), *keys[2:])
    losing = pa.array(list(loss_roles), pa.string())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                out, turn_at, begin, end = assemble(part.column("role"), part.column("text"))
                conv, null = part.column("conv_id").fill_null(0).to_numpy(), part.column("conv_id").is_null().to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])])
                bounds = np.r_[first, len(conv)]
                points = starts_of((out & 0xC0) != 0x80)  # code points before each byte
                lost = np.flatnonzero(pc.is_in(part.column("role"), losing).to_numpy(zero_copy_only=False))
                base = points[turn_at[first]][np.searchsorted(first, lost, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(points[begin[lost]] - base), pa.array(points[end[lost]] - base)], ["start", "end"])
                text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(turn_at[bounds].astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(conv[first], mask=null[first]), pa.array(seq + np.arange(len(first))), text.cast(pa.string()), pa.array(np.diff(bounds)),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(lost, bounds), pa.int32()), spans).cast(span)],
                    names=["conv_id", "seq", "text", "n_turns", "loss"])
                seq += len(first)

    return dealt.mapInArrow(run, SEGMENTS)


def turns_of(text: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a segment."""
    turns, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a text of this template")
    return turns


def read_chats(segments: DataFrame) -> DataFrame:
    """conv_id, role, text, seq, place of every turn, from the formatted text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(c, s, i, *t) for c, s, x in zip(*(part.column(k).to_pylist() for k in ("conv_id", "seq", "text")), strict=True) for i, t in enumerate(turns_of(x.encode()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[k].decode() for r in rows], pa.string()) for k in (3, 4)],
                    names=["conv_id", "seq", "place", "role", "text"])

    return segments.select("conv_id", "seq", "text").mapInArrow(run, "conv_id long, seq long, place long, role string, text string")


def digests(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the formatted text and its loss mask
    hold. The segments of a conversation are read in order, one batch at a time."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, held = None, None

        def closed() -> list:
            return [held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]]

        for batch in batches:
            done = []
            for part in slices(batch):
                for conv, text, loss in zip(*(part.column(k).to_pylist() for k in ("conv_id", "text", "loss")), strict=True):
                    if held is None or conv != at:
                        done += [closed()] if held else []
                        at, held = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in turns_of(text.encode()):
                        held[1] += 1
                        held[2].update(role + b"\n" + said + b"\n")
                    for s in loss:
                        said = unescape(text[s["start"]:s["end"]].encode())
                        held[3] += len(said.decode())
                        held[4].update(said)
                    held[5] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
