"""Helpers shared by the operators: clean inputs, Arrow batches, bounded worker caches, tokenizer files."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_file(name: str) -> str:
    """The place of an installed vocabulary file; operators take such a path as their parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()
BATCH_BYTES = 8 << 20  # of an Arrow batch; every batch in flight exists in the JVM and in a worker


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds the bytes of Arrow batches
    of long texts (a setting of the session; a smaller one stays)."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(most).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(most, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no further column can clash; a null text counts as empty."""
    ship_code(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """The whole row as one struct column ``row``: joined columns then can't clash with any of its names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unboxed(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of such rows, those named in ``new`` replaced."""
    names = docs.schema["row"].dataType.names
    return [new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in names]


def row_key(text: Column) -> Column:
    """Tells rows that share an id apart by their text; rows alike in both are one document for every decision."""
    return F.xxhash64(text)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text each (one row at least), so that a task's Python memory does
    not depend on how many long documents meet in one batch."""
    for part, _ in sliced(batch, batch.column(text), most_bytes):
        yield part


def sliced(batch: pa.RecordBatch, texts: pa.Array, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The same with the texts beside the rows, which may hold them inside a struct."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start), texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), texts.slice(start)


class Bounded(dict):
    """A worker's cache of answers of about ``most`` bytes in two generations: when the younger half is full it becomes the
    older one, and what is still asked for moves back. Memory is bounded by the size of keys and answers, not by
    their number (a key too long to keep is answered and forgotten), and answers never depend on what it holds."""

    ENTRY = 200  # bytes of an entry besides the characters and bytes that it holds

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.half, self.older, self.held = make, most // 2, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = self.ENTRY + (len(key) if isinstance(key, str) else 0) + (len(value) if isinstance(value, bytes) else 0)
        if size > self.half >> 6:
            return value
        if self.held + size > self.half:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value

    def rest(self) -> None:
        """Between two tasks only the younger half is kept."""
        self.older = {}


_WORKER: dict[tuple, object] = {}


def per_worker(kind: str, key, make: Callable):
    """The object of a Python worker (a model with its caches, a table), kept for later tasks. A worker holds one at a
    time: asking for another lets the last one go, so the stages of a pipeline don't add up in its memory."""
    if (kind, key) not in _WORKER:
        _WORKER.clear()
        _WORKER[kind, key] = make()
    return _WORKER[kind, key]
