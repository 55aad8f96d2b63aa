"""Typed scans with optional columns, and NaN turned into NULL at the door."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pegwatch.sources import schemas


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order, cast; columns an older file lacks become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark sorts NaN last and finds it equal to itself, so no operator may see one."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """A table by name or path (globs included); an empty typed one where the path does not exist."""
    reader = spark.read.format(fmt)
    try:
        if fmt == "csv":
            df = reader.option("header", True).option("enforceSchema", False).load(path)
        elif fmt == "json":
            df = reader.option("multiLine", multi_line).load(path)
        else:
            df = reader.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return nan_to_null(with_defaults(df, schema))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV or its .gz twin, only the named columns."""
    df = read_table(spark, path, schema, "csv")
    if not df.isEmpty() or path.endswith(".gz"):
        return df.select(*columns) if columns else df
    return read_csv(spark, path + ".gz", schema, columns)


def price_scan(parts: Sequence[tuple[str, DataFrame]], min_confidence: float) -> DataFrame:
    """Union of price tables; the source is the row's own tag or the table's name, a missing confidence passes."""
    out = None
    for name, df in parts:
        df = with_defaults(df, schemas.PRICES).filter(
            F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
        df = df.filter("symbol is not null and hour is not null and price is not null").withColumn(
            "source", F.coalesce("source", F.lit(name))).withColumn("unit", F.coalesce("unit", F.lit("USD")))
        out = df if out is None else out.unionByName(df)
    return out


def price_files(spark: SparkSession, paths: Sequence[str], min_confidence: float, fmt: str = "parquet", first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Price tables of several sources in one scan: files named by their source, in folders by year or not. A row's source is its own tag or
    the folder that its file lies in (``.../<source>/year=.../file``), taken from the file's metadata; columns that a file
    lacks are NULL. With years given only their folders are read."""
    known = schemas.PRICES.add("year", "integer") if "year" not in schemas.PRICES.names else schemas.PRICES
    years = range(first_year, last_year + 1) if first_year is not None else None
    asked = list(paths) if years is None else [f"{p}/year={y}" for p in paths for y in years]
    df = spark.read.format(fmt).schema(T.StructType([f for f in known.fields if f.name != "year"])).option("recursiveFileLookup", True)
    if fmt == "csv":
        df = df.option("header", True).option("enforceSchema", False)
    df = df.load(asked).select("*", "_metadata.file_path")
    folder = F.regexp_extract("file_path", r"([^/]+)/(?:year=\d+/)?[^/]+$", 1)
    df = nan_to_null(df.withColumn("source", F.coalesce("source", folder)).drop("file_path"))
    return price_scan([("", df)], min_confidence)


def registry(spark: SparkSession, path: str, in_scope_only: bool = False, include_controls: bool = True, multi_line: bool = True) -> DataFrame:
    """Asset registry from landed JSON, one document a file or one a line."""
    df = read_table(spark, path, schemas.REGISTRY, "json", multi_line)
    if in_scope_only:
        df = df.filter("in_scope")
    return df if include_controls else df.filter("coalesce(category, '') <> 'control'")


def history(df: DataFrame, ids: DataFrame, id_column: str, lag: int, priority: int = 0) -> DataFrame:
    """Entity-attribute-value rows of listed ids with the time they may be used from. Rows keep a priority of their own."""
    return (
        df.join(ids.select(id_column).distinct(), id_column, "left_semi")
        .withColumn("avail_ts", F.col("ts") + lag).withColumn("prio", F.col("prio") if "prio" in df.columns else F.lit(priority))
    )


def flatten_prices(landed: DataFrame, body: str = "body") -> DataFrame:
    """Price points out of landed API responses: {"coins": {key: {"confidence": c, "prices": [{timestamp, price}]}}}."""
    coin = "struct<confidence: double, prices: array<struct<timestamp: bigint, price: double>>>"
    parsed = F.from_json(F.col(body), f"struct<coins: map<string, {coin}>>")
    rest = [c for c in landed.columns if c != body]
    return (
        landed.select(*rest, F.explode(parsed["coins"]).alias("coin_key", "coin"))
        .select(*rest, "coin_key", F.col("coin.confidence").alias("confidence"), F.explode("coin.prices").alias("p"))
        .select(*rest, "coin_key", "confidence", F.col("p.timestamp").alias("ts"), F.col("p.price").alias("price"))
    )
