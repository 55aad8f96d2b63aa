"""The corpus pipeline over ``documents``: language ID, line dedup, near-dedup, benchmark decontamination, SentencePiece.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``. Each stage works on all rows that the one before it kept; rows with null or empty texts,
which have nothing to judge, are kept by every stage but the first (a text without a letter has no language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pegwatch.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_codec
from pegwatch.llm.common import row_key, table, tokenizer_file
from pegwatch.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose response is below the model's bound, so in none of the learned
    languages; without a model only the former. A missing ``lang`` is filled in."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.predict(docs, model, carry=True).where("accepted")
    return judged.select("row.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs go; a document of nothing else goes with them."""
    left = line_dedup.dedup_lines(docs).where(~F.col("emptied"))
    length = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays."""
    judged = near_dedup.near_duplicates(docs)
    dropped = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    return _without(docs, dropped).select(*COLUMNS)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to."""
    out = sentencepiece_codec.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows (_id, _h) of ``gone``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (row_key(text) == F.col("_h")), "left_anti")


STAGES = [
    ("language ID", identify), ("line dedup", dedup_lines), ("near-dedup", dedup_documents), ("decontamination", remove_benchmarks), ("SentencePiece", encode),
]
ORACLE_SQL = None  # near-dedup components and SentencePiece are no SQL; tests/llm holds the pipeline against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
