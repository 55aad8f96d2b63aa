"""Token ids as binary shards: independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard holds documents in ascending doc_id order (nulls first, rows with the same id by their text). Its bytes:

- data frames: little-endian unsigned 32-bit ids of whole documents, each frame a zstandard frame of its own, closed
  once it holds ``FRAME_BYTES``;
- one index frame: for each document its id (signed 64 bit), whether the id is null, its number of ids and its frame;
- a skippable frame with the seek table of the public seekable format: for each frame its compressed size, its size and
  the low 32 bits of its XXH64, then the number of frames, the checksum flag and the magic number.

A reader takes the seek table from the end, then the index, then only the frames that hold asked documents, and checks
each frame's checksum. Shards are written under a name of the attempt and renamed, so a lost executor or a second attempt
leaves one whole file. The folder must be one that all executors share.

A null text counts as empty (its document holds the end id alone); repeated rows are written as often as they occur;
very long texts get a frame of their own; an empty table makes no shard.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegwatch.llm.common import Bounded, keyed_text, per_worker, row_key, slices

FRAME_BYTES = 256 << 10
CACHED_BYTES = 256 << 20
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8"), ("frame", "<u4")])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_frames int, n_bytes long"


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the other
    bytes follow in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    return [table.setdefault(b, chr(256 + len(table) - len(own))) for b in range(256)]


class Encoder:
    """A byte-level tokenizer of the tokenizers library behind a bounded cache of words. A text is cut before a single
    space and around a single line break between other characters; no pre-token spans those places. A word is kept
    without its space; one after a line break with the break before it."""

    cuts = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
    foreign = re.compile("[^\0-\u024f]")
    closing = frozenset(".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        kind = str(tok.pre_tokenizer)
        if tok.normalizer is not None or "ByteLevel" not in kind or "use_regex=True" not in kind or "add_prefix_space=False" not in kind:
            raise ValueError("only byte-level tokenizers with their usual pattern can be cut at spaces")
        self.tok, self.letters = tok, byte_letters()
        self.space, self.newline = self.letters[32], self._whole("\n")
        self.marks = {c: self._whole(c) for c in self.closing}
        self.words = Bounded(self._word, CACHED_BYTES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, before: str = "") -> bytes:
        """Letters only are one pre-token: straight to the model. ASCII letters stand for themselves."""
        written = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tok.model.tokenize(before + written)]).tobytes()

    def _word(self, word: str) -> bytes:
        broken = word[:1] == "\n"
        body = word[1:] if broken else word
        if body and not self.foreign.search(body):
            if body.isalpha():
                return self.newline + self._letters(body) if broken else self._letters(body, self.space)
            mark = self.marks.get(body[-1])
            if mark is not None and body[:-1].isalpha():
                return self.words[word[:-1]] + mark
        return self._whole(word if broken else " " + word)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        runs = text.count(" ") + text.count("\n")
        doubled = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        if doubled or len(text.split()) != runs + 1 or text[0] in " \n" or text[-1] in " \n":
            parts = self.cuts.split(text)
            return b"".join(self.words[p[1:]] if p[0] == " " and p[1:2] not in ("", "\n") else self._whole(p) for p in parts)
        first, *rest = text.replace("\n", " \n").split(" ")  # single spaces and line breaks are all its white space
        return self._whole(first) + b"".join(map(self.words.__getitem__, rest))


class ShardWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.table, self.index, self.held, self.size, self.total, self.tokens = [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > FRAME_BYTES:
            self._close(b"".join(self.held))
            self.held, self.size = [], 0
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        self.index.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.table)))

    def _close(self, raw: bytes) -> None:
        import xxhash

        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.total += len(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def finish(self) -> None:
        if self.held:
            self._close(b"".join(self.held))
        self._close(np.array(self.index, INDEX).tobytes())
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.total += len(body) + 8


class ShardReader:
    """Random access to one shard: a frame is read, checked and decompressed when one of its documents is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable shard with checksums")
        body = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.sizes, self.sums = body[:, :2], body[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(body[:, 0])])
        self.index = np.frombuffer(self.frame(frames - 1), INDEX)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k} differs")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this shard, its ids as bytes), all or only those asked for."""
        before = np.concatenate([[0], np.cumsum(self.index["n"].astype(np.int64))])
        picks = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index["id"], list(wanted)) & (self.index["null"] == 0))
        at, raw, base = -1, b"", 0
        for i in picks:
            k = int(self.index["frame"][i])
            if k != at:
                at, raw, base = k, self.frame(k), int(before[np.searchsorted(self.index["frame"], k)])
            lo = (int(before[i]) - base) * 4
            yield None if self.index["null"][i] else int(self.index["id"][i]), int(before[i]), raw[lo:lo + 4 * int(self.index["n"][i])]


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every document and writes the shards; returns their manifest (a row for each shard), itself written in the
    folder. Documents are dealt by ranges of (doc_id, text hash), so shard order is document order and a document's
    size or a repeated id never decides how much one task gets."""
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", row_key(F.col("text")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = per_worker("ids", tokenizer_path, lambda: Encoder(tokenizer_path))
        end = struct.pack("<I", end_id)
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/shard-{context.partitionId():06d}.ids.zst"
        attempt = f"{name}.{context.taskAttemptId()}.{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as out:
            writer = ShardWriter(out)
            for batch in batches:
                for part in slices(batch):
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        writer.add(doc_id, encode(text) + end)
            writer.finish()
        if not writer.index:
            store.delete_file(attempt)
            return
        store.move(attempt, name)
        row = {"shard": context.partitionId(), "path": name, "n_docs": len(writer.index), "n_tokens": writer.tokens, "n_frames": len(writer.table), "n_bytes": writer.total}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_frames", pa.int32()), ("n_bytes", pa.int64())]))

    ordered.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (its little-endian 32-bit ids), from the files. With
    ``wanted`` only the frames that hold those documents are decompressed."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row for each shard: the only window without a key, over as many rows as there are files
    base = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = manifest.select("shard", "path", F.coalesce(base, F.lit(0)).alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = None if wanted is None else sorted(set(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    held, size = [], 0
                    for doc_id, before, ids in ShardReader(source).documents(asked):
                        held.append({"doc_id": doc_id, "start": row["base"] + before, "ids": ids})
                        size += len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return shards.repartition(parts, "shard").mapInArrow(run, "doc_id long, start long, ids binary")
