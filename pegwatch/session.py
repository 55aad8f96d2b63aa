"""Session settings and the written stage tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_STAGES: dict[tuple[str, str, str], DataFrame] = {}
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local one only where none is set on a local master,
    as in tests. Executors of a cluster don't share a machine's own folders, so there an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _FALLBACK[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, column pruning and size
    statistics work on what follows, and a lost executor re-reads instead of recomputing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def staged(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A job boundary: the table is written once per session and input folder and read by every later job."""

    @wraps(fn)
    def once(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _STAGES:
            _STAGES[key] = cut(fn(spark, sf), fn.__name__)
        return _STAGES[key]

    once.build = fn
    return once


def forget_stages() -> None:
    """Makes later jobs write their stage tables again (used by the benchmark, so that nothing is measured twice)."""
    _STAGES.clear()
