"""Table sinks, keyed upserts and small report tables."""

from __future__ import annotations

from collections.abc import Sequence

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pegwatch.session import shared_folder
from pegwatch.sources.scans import with_defaults


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Gzip CSV with doubles at ``digits`` significant digits."""
    cols = [
        F.format_string(f"%.{digits}g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_by_year(df: DataFrame, path: str, ts: str = "ts") -> None:
    """One partition per year; re-running one year replaces only that year."""
    (
        df.withColumn("year", F.year(F.timestamp_seconds(ts))).repartition("year", F.floor(F.col(ts) / 86400))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    )


def floored_edges(edges: DataFrame, min_usd: float) -> DataFrame:
    """Edges worth writing: above the floor, or unpriced with tokens in them."""
    known = F.col("usd").isNotNull() | F.col("tokens").isNotNull()
    keep = (F.col("usd") >= min_usd) | (F.col("usd").isNull() & (F.coalesce("tokens", F.lit(0.0)) > 0))
    return edges.filter(known & keep)


SLICES = 16
# The types of edges that a snapshot writes.
EDGE_TYPES = ("collateral", "supply", "borrow", "allocation", "vault_asset", "pool_supply", "pool_borrow")


def write_edges(edges: DataFrame, path: str, min_usd: float) -> DataFrame:
    """Kept edges, one partition per day; returns (etype, before, after). The counts are observed by the write itself, so the edges are
    computed once. A day is dealt over ``SLICES`` tasks by its edges' ends, so a type with most of the edges is spread and a day's files stay few."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = [F.count(F.when(F.col("etype") == k, 1)).alias(k) for k in EDGE_TYPES]
    before, after = Observation(), Observation()
    known = edges.filter(F.col("usd").isNotNull() | F.col("tokens").isNotNull()).observe(before, *counts)
    dated = floored_edges(known, min_usd).observe(after, *counts).withColumn("day", F.to_date(F.timestamp_seconds("t")))
    # dealt by hash: a range would sample its input first and so observe it twice
    dated.repartition(parts, "day", F.pmod(F.xxhash64("etype", "src", "dst"), F.lit(SLICES))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    b, a = before.get, after.get
    return edges.sparkSession.createDataFrame([(k, b[k], a[k]) for k in EDGE_TYPES if b[k]], "etype string, before long, after long")


def edge_counts(edges: DataFrame, min_usd: float) -> DataFrame:
    """Rows before and after the floor by edge type."""
    known = edges.filter(F.col("usd").isNotNull() | F.col("tokens").isNotNull())
    keep = (F.col("usd") >= min_usd) | (F.col("usd").isNull() & (F.coalesce("tokens", F.lit(0.0)) > 0))
    return known.groupBy("etype").agg(F.count("*").alias("before"), F.count(F.when(keep, 1)).alias("after"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old rows with their key; the others stay."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


BUCKETS = 64


def _bucketed(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def upsert_stored(new: DataFrame, path: str, key: Sequence[str], schema: StructType, buckets: int = BUCKETS) -> list[int]:
    """Replaces the rows of a stored table whose keys ``new`` has; returns the buckets that were written. The table lies in folders by a hash of the
    key. Only folders that hold a new key are read and written again, by way of a staged table, so what is
    replaced is never read while it is written; the other folders' files are not touched, and a second run of the same rows
    changes no row. At most ``buckets`` numbers reach the driver."""
    spark, key = new.sparkSession, list(key)
    staged = f"{shared_folder(spark)}/upserts/{uuid.uuid4().hex}"
    arriving = _bucketed(with_defaults(new, schema), key, buckets)
    arriving.write.parquet(f"{staged}/new")
    arriving = spark.read.parquet(f"{staged}/new")
    touched = sorted(r[0] for r in arriving.select("bucket").distinct().collect())
    stored = read_stored(spark, path, schema).where(F.col("bucket").isin(touched))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    kept = stored.alias("o").join(arriving.select(*key).distinct().alias("n"), same, "left_anti")
    kept.unionByName(arriving).repartition("bucket", F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(8))).write.parquet(f"{staged}/merged")
    spark.read.parquet(f"{staged}/merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def read_stored(spark, path: str, schema: StructType) -> DataFrame:
    """The stored table with its ``bucket``; empty where nothing is stored yet."""
    from pegwatch.sources.scans import read_table

    full = StructType([*schema.fields]).add("bucket", "integer")
    return read_table(spark, path, full)


def markdown_rows(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """A report table as lines of Markdown: one ``line`` per row with its position, header first. The rows are
    formatted where they are; a caller collects the few lines of an aggregated table only."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    head = df.sparkSession.createDataFrame(
        [(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + "---|" * len(df.columns))], "sort_key int, line string")
    body = df.select(F.lit(0).alias("sort_key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body)
