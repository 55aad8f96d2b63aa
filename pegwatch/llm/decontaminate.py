"""Benchmark decontamination by a broadcast hash set of n-grams. DataFrame operations only.

Words: A-Z lower-cased, then runs of a-z, 0-9 and everything from U+0080 on. A window is ``size`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is
hit. A document is contaminated when it has hits and 20 * n_hit >= n_words.

Method: the distinct windows of all items, with their hash and the items they stand in, are one table. A document's
windows are hashed in its row and screened by a small bit table of the benchmark's hashes; only windows that pass leave
the row, with their words, and meet the hash set: broadcast while the benchmark has at most ``BROADCAST_WINDOWS`` windows
(counted first), an ordinary shuffled join beyond. A hit is verified by comparing the words. Documents without any
window are carried along, so one pass over the texts gives the report of every document.

A null text has no words, nor has one of separators alone: no hits, not contaminated. Items without words have no window;
an item without an id hits words but is not listed. Rows alike in id and text are one document (one report row); an empty
benchmark contaminates nothing, an empty table gives an empty table. Further columns of ``documents`` stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegwatch.llm.common import boxed, row_key, unboxed
from pegwatch.session import cut

SIZE = 13
BROADCAST_WINDOWS = 1_000_000
SCREEN_WORDS = 1 << 16  # 64-bit words of the bit table
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{SEPARATORS}]+"), "")


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """hash, gram (its words), items (sorted ids as strings) of each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    each = items.select("item", F.explode(grams).alias("gram")).groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return each.select(F.xxhash64("gram").alias("hash"), "gram", "items")


def _screen(windows: DataFrame) -> Column:
    """The bit table as a literal array: bit (hash & 63) of word (hash >> 6) & (SCREEN_WORDS - 1)."""
    word, bit = _place(F.col("hash"))
    filled = windows.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    bits = ["0"] * SCREEN_WORDS
    for r in filled.collect():  # at most SCREEN_WORDS rows, whatever the benchmark's size
        bits[r["word"]] = str(r["bits"])
    return F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")


def _place(h: Column) -> tuple[Column, Column]:
    return F.shiftright(h, 6).bitwiseAND(F.lit(SCREEN_WORDS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def hits_of(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (of the text), n_words, spans (pos from 1, len of each verified window), items (sorted ids as strings)."""
    windows = cut(benchmark_windows(benchmark, size), "benchmark_windows")
    shape = windows.groupBy(F.size("gram").alias("len")).count().collect()  # at most ``size`` rows
    screen = _screen(windows)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(text).alias("h"), words_of(text).alias("words"))

    def candidates(length: int) -> Column:
        def passes(i: Column) -> Column:
            word, bit = _place(F.xxhash64(F.slice("words", i, length)))
            return F.getbit(F.get(screen, word), bit) == 1

        starts = F.when(F.size("words") >= length, F.sequence(F.lit(1), F.size("words") - length + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, passes), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.slice("words", i, length).alias("gram")))

    lengths = sorted(r["len"] for r in shape)
    found = F.flatten(F.array(*(candidates(n) for n in lengths))) if lengths else F.array().cast("array<struct<pos:int,len:int,gram:array<string>>>")
    at = rows.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.explode_outer(found).alias("c"))
    at = at.withColumn("hash", F.xxhash64("c.gram"))
    known = windows.select(F.col("hash").alias("_hash"), F.col("gram").alias("_gram"), "items")
    if sum(r["count"] for r in shape) <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    met = at.join(known, (F.col("hash") == F.col("_hash")) & (F.col("c.gram") == F.col("_gram")), "left")
    span = F.when(F.col("_hash").isNotNull(), F.struct("c.pos", "c.len"))
    each = met.groupBy("doc_id", "h").agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("items").alias("lists"))
    return each.select("doc_id", "h", "n_words", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))


def hit_words(spans: Column) -> Column:
    """Positions of the words inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_words, n_hit, items, contaminated."""
    out = hits_of(docs, benchmark, size, id_col, text_col).withColumn("n_hit", F.size(hit_words(F.col("spans"))).cast("long"))
    return out.select("doc_id", "h", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = report(docs, benchmark, size, id_col, text_col).where("contaminated").select("doc_id", "h")
    rows = boxed(docs)
    left = rows.join(bad, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (row_key(F.col(f"row.`{text_col}`")) == F.col("h")), "left_anti")
    return left.select(*unboxed(rows))


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every hit word, and the separators before it, taken out of the text."""
    text = F.col(f"row.`{text_col}`")
    hit = hits_of(docs, benchmark, size, id_col, text_col).where(F.size("spans") > 0).select("doc_id", "h", hit_words(F.col("spans")).alias("hit"))
    rows = boxed(docs)
    met = rows.join(hit, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (row_key(text) == F.col("h")), "left")
    upper = SEPARATORS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(text, F.lit(f"[{upper}]*[^{upper}]+|[{upper}]+$"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(pieces)), F.col("hit")), lambda i: F.get(pieces, i - 1))
    return met.select(*unboxed(rows, **{text_col: F.when(F.col("hit").isNotNull(), F.array_join(kept, "")).otherwise(text)}))
