"""Order statistics without a single-task sort.

A window over the whole of a table, or over one hot group, would put it into one task. The functions here deal the rows
out by ranges of the value instead (then of the group, so that a value shared by many groups is split too), as many
ranges as the session has shuffle partitions, and write them once with the number of their range. The few range totals
are accumulated, and the fine running sums are taken inside each range only. Results are exact. The written table is
what every later step reads, so lost executors and re-runs can't change the ranges. NULL groups are groups like any
other; NULL values come first in ascending and last in descending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.session import cut


def by_range(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``_bucket``, the number of the row's range in the order of the columns."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("_bucket", F.spark_partition_id()), "ranges")


def _meet(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the offsets of its (group, range); NULL groups meet too."""
    keys = [*by, "_bucket"]
    named = offsets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) if k != "_bucket" else F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return rows.join(named, same)


def running_totals(counted: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Running sums of ``sums`` in the order of ``value`` inside every ``by`` group.

    ``counted`` holds one row per (by, value). Adds ``cum_<s>`` (row included) and ``all_<s>`` (group total).
    """
    by = list(by)
    rows = by_range(counted, [value, *by])
    per_bucket = rows.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    fine = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(F.col(value).desc() if descending else F.col(value).asc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return _meet(rows, offsets, by).select(
        *counted.columns,
        *[(F.sum(s).over(fine) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per entry of ``probs``."""
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = running_totals(counted, value, ["_n"], by)
    picks, outs = [], []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("all__n") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("cum__n") > at) & (F.col("cum__n") - F.col("_n") <= at)
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{side}"))
        frac = F.lit(float(p)) * (F.col("_total") - 1) - F.floor(F.lit(float(p)) * (F.col("_total") - 1))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return run.groupBy(*by).agg(F.max("all__n").alias("_total"), *picks).select(*by, *outs)


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Distinct keys numbered 0, 1, ... in key order."""
    keys = df.select(key).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    run = running_totals(keys, key, ["_one"])
    return run.select(key, (F.col("cum__one") - 1).alias(name), F.col("all__one").alias(f"n_{name}"))


def ranked(df: DataFrame, order: Sequence[tuple[str, bool]], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (1 is first) and ``total`` per group. ``order`` lists (column, descending) pairs that together
    order the rows totally; descending columns must be numbers. The ranges cut the whole key, so a score that a third
    of the rows share is split by the columns after it."""
    by = list(by)
    key = F.struct(*[(-F.col(c) if desc else F.col(c)).alias(f"k{i}") for i, (c, desc) in enumerate(order)])
    rows = by_range(df.withColumn("_key", key), ["_key"])
    per_bucket = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_b"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*by, "_bucket", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_o"),
                                F.sum("_b").over(Window.partitionBy(*by)).alias("total"))
    fine = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key"))
    return _meet(rows, offsets, by).select(*df.columns, (fine + F.col("_o")).alias("rank"), "total")


def top_rows(
    df: DataFrame, order: Sequence[tuple[str, bool]], share: float | None = None, k: Column | None = None,
    by: Sequence[str] = (), flag: str = "top",
) -> DataFrame:
    """Marks exactly the first ``bround(share * N)`` (or ``k``) rows of every group."""
    limit = F.bround(F.lit(float(share)) * F.col("total")) if share is not None else k
    return ranked(df, order, by).select(*df.columns, (F.col("rank") <= limit).alias(flag))
