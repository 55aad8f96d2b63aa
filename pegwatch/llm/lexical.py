"""Ranked lexical search by an Aho-Corasick scan of the documents, without a document index.

Method: the terms of all items (the query set) are the patterns of one automaton, each guarded by a blank on both sides; a text is
lower-cased and every character that is no part of a term becomes a blank, so a match of a pattern is exactly one whole term.
The matches of one pass over a text are its term frequencies. An automaton's output is a term's number, and a map from terms
to items (with their repeats) turns the weights of one document into scores of all items at once.

Two scans of the texts: the first sums the documents that hold a term and the lengths (arrays of a task, combined before
anything is sent), the second scores and keeps each task's best rows for each item; those few are ranked. No posting is written or
shuffled.

Items are dealt into blocks of ``BLOCK_BYTES`` of text at most (measured; an item beyond it has a block of its own), and one
block after another is collected, broadcast and searched for: what a worker holds is bounded by the block, not by the
items' number.

Terms are maximal runs of letters A-Z, a-z, digits and characters beyond U+007F, only A-Z lower-cased. A null text has no
terms; it, and a text without any, count neither as a document nor in a length. Rows of documents count as they occur, rows alike
in id and text too; null ids come last among equal scores. Items alike in id and text are one; those that share only the id are ranked
each on its own. An item without terms, or whose terms no document holds, gives no rows. Very long texts are scanned whole;
empty tables give an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pegwatch.llm.common import keyed_text, per_worker, slices

TOP, BLOCK_BYTES = 20, 1 << 20
SCALE, PIVOT, RISE = 1_000_000_000, 100, 25  # fixed values of the score
BLANK = 0x20


def term_bytes() -> bytes:
    """For each byte of UTF-8 what the scan sees: A-Z lower-cased, bytes of terms as they are, the others as blanks."""
    kept = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in kept else BLANK for b in range(256))


SEEN = term_bytes()


def seen(raw: bytes) -> bytes:
    return raw.translate(SEEN)


class Items:
    """A block of items: its terms, their automaton and the map from terms to items. Texts are read as one character a byte."""

    def __init__(self, texts: list[str]):
        self.terms: dict[bytes, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for item, text in enumerate(texts):
            for term in seen((text or "").encode()).split():
                key = self.terms.setdefault(term, len(self.terms)), item
                pairs[key] = pairs.get(key, 0) + 1
        order = sorted(pairs)
        self.items = np.array([i for _, i in order], np.int64)
        self.repeats = np.array([pairs[k] for k in order], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in order], np.int64), np.arange(len(self.terms) + 1))
        self.count = len(texts)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}  # each worker makes its own

    def frequencies(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The block's terms in an already blanked text, and how often each occurs."""
        if not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term, number in self.terms.items():
                self.automaton.add_word(f" {term.decode('latin-1')} ", number)
            self.automaton.make_automaton()
        hits = np.fromiter(map(itemgetter(1), self.automaton.iter(f" {text.decode('latin-1')} ")), np.int64)
        return np.unique(hits, return_counts=True)

    def scores(self, terms: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that hold one of the terms, and for each the sum of the terms' gains, repeats included."""
        lo, hi = self.first[terms], self.first[terms + 1]
        sizes = hi - lo
        at = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = np.zeros(self.count, np.int64)
        np.add.at(total, self.items[at], self.repeats[at] * np.repeat(gains, sizes))
        found = np.flatnonzero(total)
        return found, total[found]


def length_of(text: bytes) -> int:
    """Number of terms of a blanked text."""
    inside = np.frombuffer(b" " + text, np.uint8) != BLANK
    return int((inside[1:] & ~inside[:-1]).sum())


class Best:
    """The ``top`` rows of each item that a task has met: higher scores first, then smaller ids, nulls last."""

    def __init__(self, top: int):
        self.top, self.parts, self.held, self.floor = top, [], 0, None

    def add(self, items: np.ndarray, scores: np.ndarray, doc_id: int | None) -> None:
        if self.floor is not None:
            hopeful = scores >= self.floor[items]
            items, scores = items[hopeful], scores[hopeful]
        if len(items):
            self.parts.append((items, scores, np.full(len(items), doc_id or 0, np.int64), np.full(len(items), doc_id is None)))
            self.held += len(items)

    def prune(self, count: int) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool)]
        items, scores, ids, null = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, null, -scores, items))
        items = items[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        keep = order[place < self.top]
        self.parts = [(items[place < self.top], scores[keep], ids[keep], null[keep])]
        self.held = len(keep)
        self.floor = np.zeros(count, np.int64)
        last = place == self.top - 1
        self.floor[items[last]] = scores[order[last]]
        return list(self.parts[0])


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list]:
    """Blocks of items (id, text), dealt by a hash; the number of blocks doubles until the largest is within the bound or
    holds one item."""
    own = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()
    sized = own.select("*", F.xxhash64("item_id", "text").alias("h"), F.octet_length("text").cast("long").alias("bytes"))
    total = sized.agg(F.sum("bytes")).first()[0]
    if total is None:
        return
    number = max(1, -(-total // most))
    while True:
        dealt = sized.withColumn("block", F.pmod("h", F.lit(number)))
        over = dealt.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > most) & (F.col("n") > 1))
        if number == 1 and total <= most or number > 1 << 40 or over.isEmpty():
            break
        number *= 2
    for block in (r[0] for r in dealt.select("block").distinct().orderBy("block").toLocalIterator()):
        yield sorted(((r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def statistics(rows: DataFrame, shared, made: str) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each of the block's terms the documents that hold it."""
    shape = pa.schema([("kind", pa.int32()), ("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = per_worker("lexical", made, lambda: shared.value)
        holding, documents, length = np.zeros(len(known.terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text"):
                    blanked = seen(text.as_buffer().to_pybytes())
                    n = length_of(blanked)
                    documents, length = documents + (n > 0), length + n
                    holding[known.frequencies(blanked)[0]] += 1
        met = np.flatnonzero(holding)
        kinds = [0, 1] + [2] * len(met)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([0, 0, *met.tolist()], pa.int64()), pa.array([documents, length, *holding[met].tolist()], pa.int64())], schema=shape)

    found = rows.select("text").mapInArrow(run, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block
    sums = {(r["kind"], r["term"]): r["n"] for r in found}
    holding = np.array([sums.get((2, t), 0) for t in range(len(shared.value.terms))], np.int64)
    return sums.get((0, 0), 0), sums.get((1, 0), 0), holding


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = items.schema[item_col].dataType
    shape = "block int, item int, score long, doc_id long"
    found, names = None, []
    for number, block in enumerate(blocks(items, item_col, item_text_col, block_bytes)):
        made, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(Items([t for _, t in block]))
        documents, length, holding = statistics(rows, shared, made)
        if not length:
            break
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))).astype(np.int64)
        part = rows.mapInArrow(scorer(shared, made, spark.sparkContext.broadcast(weights), documents, length, number, top), shape)
        found = part if found is None else found.unionByName(part)
        names += [(number, i, item) for i, (item, _) in enumerate(block)]
    named = T.StructType().add("block", T.IntegerType()).add("item", T.IntegerType()).add("item_id", kind)
    if found is None:
        found = spark.createDataFrame([], shape)
    order = W.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(spark.createDataFrame(names, named), ["block", "item"]).select("item_id", "rank", "doc_id", "score")


def scorer(shared, made: str, weighed, documents: int, length: int, number: int, top: int):
    """The second scan as a function of a task's batches."""
    shape = pa.schema([("block", pa.int32()), ("item", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = per_worker("lexical", made, lambda: shared.value)
        weights, best = weighed.value, Best(top)
        room = max(1 << 20, 4 * top * known.count)
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    blanked = seen(text.as_buffer().to_pybytes())
                    terms, often = known.frequencies(blanked)
                    if len(terms):
                        m = PIVOT - RISE + RISE * length_of(blanked) * documents // length
                        best.add(*known.scores(terms, weights[terms] * (SCALE * often // (1000 * often + 12 * m))), doc_id)
                    if best.held > room:
                        best.prune(known.count)
        items, scores, ids, null = best.prune(known.count)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), number), pa.int32()), pa.array(items, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=null)], schema=shape)

    return run
