"""Line dedup by winnowing over line hashes. DataFrame operations only.

A run is a stretch of consecutive lines; it counts when it holds ``min_words`` words (so one long line is a run). A line
goes when it lies in a counting run that occurs earlier: in a document with a smaller doc_id, or further up in the same
document without overlapping. Lines compare without the spaces, tabs and carriage returns around them; blank lines don't
count and stay. A line has one word more than spaces inside it.

Method: around every line stand two windows, the shortest counting runs that begin and that end with it. Every counting
run that repeats contains whole windows that repeat, and they cover it. A window's fingerprint is the least line hash in
it, so the two occurrences of a repeated window choose the same line. Fingerprints that occur at one place only are
discarded with their windows; what is left is joined by its positions: the earliest occurrence of a window stays, a later
one is marked, and marked windows next to each other extend a match both ways to its full length. A fingerprint shared by
a third of all lines costs a minimum and a maximum, never its pairs.

A null text stays null, an empty one empty. Rows alike in id and text are one document for every decision and get the same
result; rows that share only the id are told apart by their text. Null ids come last in the order of documents. Very long
documents are split into lines like any other; an empty table gives an empty table. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegwatch.llm.common import boxed, row_key, unboxed
from pegwatch.session import cut

MIN_WORDS = 50
LAST = (1 << 63) - 1


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, h, pos, words, and two hashes a and b for each line that has words."""
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    lines = docs.select("doc", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc", "h", "pos", line.alias("line")).where("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return lines.select("doc", "h", "pos", words.cast("long").alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))


def windows_of(lines: DataFrame, min_words: int) -> DataFrame:
    """doc, h, lo, hi (first and last line), a, b (hashes of the lines in order), fp (least hash) and at (its line)."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc", "h"]
    one = lines.repartition(parts, *key).groupBy(*key, "pos").agg(*(F.min(c).alias(c) for c in ("words", "a", "b")))
    after = F.sum("words").over(W.partitionBy(*key).orderBy("pos"))
    placed = one.withColumn("after", after).withColumn("before", F.col("after") - F.col("words"))
    ahead = W.partitionBy(*key).orderBy("before").rangeBetween(0, min_words - 1)
    back = W.partitionBy(*key).orderBy("after").rangeBetween(1 - min_words, 0)

    def window(over, first, last):
        least = F.min(F.struct("a", "pos")).over(over)
        return F.struct(first.alias("lo"), last.alias("hi"), F.xxhash64(F.collect_list("a").over(over)).alias("a"), F.xxhash64(F.collect_list("b").over(over)).alias("b"),
                        least["a"].alias("fp"), least["pos"].alias("at"), F.sum("words").over(over).alias("total"))

    both = placed.select(*key, "words", window(ahead, F.col("pos"), F.max("pos").over(ahead)).alias("x"), window(back, F.min("pos").over(back), F.col("pos")).alias("y"))
    # a window that ends with its line and that also is the shortest from its first line on is there already
    keep = F.array_compact(F.array(
        F.when(F.col("x.total") >= min_words, F.col("x")),
        F.when((F.col("y.total") >= min_words) & (F.col("y.total") - F.col("words") >= min_words), F.col("y"))))
    return both.select(*key, F.explode(keep).alias("w")).select(*key, "w.lo", "w.hi", "w.a", "w.b", "w.fp", "w.at")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, h, marks: for each document that has later repeats the marked windows (lo, hi)."""
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"), row_key(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    windows = cut(windows_of(lines_of(keyed), min_words), "line_windows")
    place = F.struct("doc", "h", "at")
    shared = windows.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("fp")
    seen = cut(windows.join(shared, "fp").drop("fp", "at"), "line_matches")
    first = seen.groupBy("a", "b").agg(F.min(F.struct("doc", "h", "lo", "hi")).alias("first"), F.max(F.struct("doc", "h", "lo", "hi")).alias("last")).where("first < last")
    other = (F.col("first.doc") != F.col("doc")) | (F.col("first.h") != F.col("h")) | (F.col("first.hi") < F.col("lo"))
    later = seen.join(first.select("a", "b", "first"), ["a", "b"]).where(other)
    return later.groupBy("doc", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts after deletion, and ``lines_removed`` and ``emptied`` (no line with words
    is left of a document that had some; its text is then empty)."""
    text, rows = F.col(f"row.`{text_col}`"), boxed(docs)
    marks = repeated_runs(docs, min_words, id_col, text_col)
    on = (F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(LAST)) == F.col("doc")) & (row_key(text) == F.col("h"))
    met = rows.join(marks.hint("shuffle_hash"), on, "left")
    gone = F.array_distinct(F.flatten(F.transform("marks", lambda m: F.sequence(m["lo"], m["hi"]))))
    met = met.withColumn("lines", F.when(F.col("marks").isNotNull(), F.split(text, "\n")))
    met = met.withColumn("gone", F.filter(gone, lambda i: F.trim(F.get("lines", i), F.lit(" \t\r")) != ""))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    met = met.withColumn("left", F.when(F.col("marks").isNotNull(), left))
    words = F.exists("left", lambda x: F.trim(x, F.lit(" \t\r")) != "")
    emptied = F.coalesce(F.col("marks").isNotNull() & ~words, F.lit(False))
    new = F.when(F.col("marks").isNull(), text).when(emptied, F.lit("")).otherwise(F.array_join("left", "\n"))
    return met.select(*unboxed(rows, **{text_col: new}), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_removed"), emptied.alias("emptied"))
