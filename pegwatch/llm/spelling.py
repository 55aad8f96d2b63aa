"""Spelling variants grouped by PartEnum signatures. DataFrame operations only.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), only A-Z lower-cased, that have ``LEAST`` code points or
more and occur twice at least. A run whose checksum with its document's id is divisible by ``EVERY`` loses one letter first (a
fixed rule that gives the corpus spelling errors of known shape).

Method: a word is the binary vector of its letters' occurrences (the second "e" is a place of its own). One replaced letter
changes two places, one inserted or deleted letter changes one, so near words have Hamming distance two at most. The places
are dealt into parts; of vectors of one length at distance two one of three parts agrees exactly, of vectors of
neighbouring lengths at distance one one of two parts. Which part, its content, the length and one half of the word (near words
share a half) are a signature; near words share one at least, and an equi-join of the signatures followed by the edit distance
finds exactly the near pairs.

A signature that more than ``CROWD`` words share is refined before the join by every place of the word and the word without it.
Such a key is shared by no more words than there are letters (times the length, where a letter was inserted), so no group of
pairs grows with the data, and nothing is dropped. Words of a crowded signature are counted by partial sums; what they are
joined with is one row for each signature.

A word's form is its near word of the largest count (ties: smallest in code-point order) where that count is ten times its own or more;
its root is what its forms lead to. Counts grow tenfold a step, so the path is short and is followed by doubling.

A null or empty text has no words. Rows count as often as they occur; a null id is written as the empty string in the
checksum. Very long texts and words are read whole; an empty table, or one without words, gives an empty table. Further columns
are not read.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegwatch.session import cut

LEAST, OFTEN, EVERY, TIMES = 7, 2, 31, 10
PARTS, CROWD = 3, 64
FREQUENT = "esiantrolducmpgvhfbqyxjkwz"  # neighbours in this order lie in different parts
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAME, SHORTER, LONGER = 0, 1, 2


def without(word: Column, place: Column) -> Column:
    """The word without its code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n. Only runs that are long enough leave the pattern; counts are combined before the shuffle."""
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST},}}"), F.lit(0))).alias("run"))
    # lower() would change accented capitals too
    run = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run"))
    runs = runs.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, without(F.col("run"), place)).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= OFTEN) & (F.length("word") >= LEAST))


def signatures(words: DataFrame) -> DataFrame:
    """word, n, key, role: what a word contributes for partners of its own length, longer and shorter ones."""
    letters = words.withColumn("letters", F.array_sort(F.filter(F.split("word", ""), lambda c: c != "")))

    def place(c: Column, i: Column) -> Column:
        again = i - F.array_position("letters", c) + 1
        rank = F.instr(F.lit(FREQUENT), c)
        return F.struct((F.when(rank > 0, rank).otherwise(F.ascii(c)) + again).alias("turn"), F.xxhash64(c, again).alias("h"))

    placed = letters.withColumn("places", F.transform("letters", place))

    def part(p: int, of: int) -> Column:
        return F.xxhash64(F.transform(F.filter("places", lambda x: F.pmod(x["turn"], F.lit(of)) == p), lambda x: x["h"])).alias(f"p{of}{p}")

    parts = placed.select("word", "n", F.length("word").alias("size"), *(part(p, of) for of in (PARTS, PARTS - 1) for p in range(of)))

    def chosen(of: int, size: Column, gap: int, role: int) -> list[Column]:
        """Each part with each half of the word; a longer word's halves lie beside the letter that its partner lacks."""
        half = F.floor(size / 2).cast("int")
        one, two = F.substring("word", F.lit(1), half), F.substring("word", half + gap + 1, F.length("word"))
        return [F.struct(F.xxhash64(F.lit(10 * of + p), size, f"p{of}{p}", F.lit(k), half_word).alias("key"), F.lit(role).cast("byte").alias("role"))
                for p in range(of) for k, half_word in enumerate((one, two))]

    size = F.col("size")
    every = chosen(PARTS, size, 0, SAME) + chosen(PARTS - 1, size, 0, SHORTER) + chosen(PARTS - 1, size - 1, 1, LONGER)
    return parts.select("word", "n", F.explode(F.array(*every)).alias("s")).select("word", "n", "s.key", "s.role")


def holes() -> Column:
    """Keys of the word without each of its letters; of a shorter word its own."""
    where = F.when(F.col("role") == SAME, F.lit(1)).otherwise(F.lit(0))
    each = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.xxhash64("key", i * where, without(F.col("word"), i)))
    return F.when(F.col("role") == SHORTER, F.array(F.xxhash64("key", F.lit(0), "word"))).otherwise(F.array_distinct(each))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, na, b, nb: each pair of words one inserted, deleted or replaced code point apart, once."""
    keyed = signatures(words)
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > crowd)
    judged = keyed.join(crowded, "key", "left")
    refined = judged.where("size is not null").select("word", "n", "role", F.explode(holes()).alias("key"))
    return met(judged.where("size is null")).unionByName(met(refined)).distinct()


def met(keyed: DataFrame) -> DataFrame:
    """The near pairs among words with the same key."""
    one = keyed.where(F.col("role") != LONGER).select("key", F.col("role").alias("ra"), F.col("word").alias("a"), F.col("n").alias("na"))
    two = keyed.where(F.col("role") != SHORTER).select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    first = (F.col("ra") == SHORTER) | (F.col("a") < F.col("b"))
    return one.join(two, "key").where(first & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n, for every word."""
    words = cut(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = cut(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    leads = -F.col("best.less") >= times * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best.other")).alias("form"),
                               F.when(leads, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("form_n")).first()[0]
    steps = 1 if most is None else max(1, ceil(log(most, times)))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        roots = cut(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
                    .select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
