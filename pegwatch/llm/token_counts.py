"""Token counts by a two-tier lookup, without shuffling any pre-token.

Method: words between spaces and line breaks are counted on their own (the tokenizer drops white space before it splits,
so the count of a text is the sum over its words). A compact table with the lengths of frequent words is broadcast; a
word it lacks goes to a bounded cache of the worker, and what that lacks is encoded by the tokenizers library.

The table only saves work: it is made from a bounded sample (``SAMPLE_ROWS`` documents, ``TABLE_WORDS`` words), its
lengths come from the same tokenizer, and every count is the library's whatever the table holds. Special strings inside
a text are handled as the library does by default. A null or empty text has 0 tokens; repeated rows give repeated
results, very long texts are counted whole, an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.llm.common import Bounded, keyed_text, per_worker, slices

SAMPLE_ROWS = 2_000
TABLE_WORDS = 65_536
CACHED_BYTES = 96 << 20


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def word_counter(path: str):
    """A function from a word to its number of tokens. Only for tokenizers that drop white space before they split."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    if len(tok.encode("a \n a", add_special_tokens=False)) != 2 * len(tok.encode("a", add_special_tokens=False)):
        raise ValueError("the tokenizer keeps white space; words can't be counted on their own")
    return lambda word: len(tok.encode(word, add_special_tokens=False)) if word else 0


def frequent_words(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = TABLE_WORDS) -> list[str]:
    """The commonest words of a bounded sample of documents (the smallest hashes of ids)."""
    hashes = rows.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample_rows)
    edge = hashes.agg(F.max("h")).first()[0]
    if edge is None:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen = Counter()
                for text in part.column("text").to_pylist():
                    seen.update(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    sample = rows.where(F.xxhash64("doc_id") <= edge).limit(sample_rows)
    top = (
        sample.mapInArrow(count, "word string, n long").where("length(word) between 1 and 64")
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    )
    return [r[0] for r in top.collect()]


class TwoTier(dict):
    """Frequent words first, then the worker's bounded cache, then the tokenizer."""

    def __init__(self, words: list[str], lengths: np.ndarray, count):
        super().__init__(zip(words, lengths.tolist(), strict=True))
        self.cache = Bounded(count, CACHED_BYTES)

    def __missing__(self, word: str) -> int:
        return self.cache[word]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row. One narrow pass over the texts."""
    rows = keyed_text(docs, id_col, text_col)
    spark = docs.sparkSession
    count = word_counter(tokenizer_path)
    words = frequent_words(rows)
    lengths = np.array([count(w) for w in words], "<u2")
    made = uuid.uuid4().hex
    table = spark.sparkContext.broadcast(("\n".join(words), lengths.tobytes()))  # at most TABLE_WORDS words

    def tiers() -> TwoTier:
        blob, sizes = table.value
        return TwoTier(blob.split("\n") if blob else [], np.frombuffer(sizes, "<u2"), word_counter(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker("counts", (tokenizer_path, made), tiers)
        lookup = counts.__getitem__
        for batch in batches:
            for part in slices(batch):
                n = [sum(map(lookup, words_of(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        counts.cache.rest()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
