"""What the scanners for secrets and personal data share: span digests, hashes of rows, adaptive steps in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pegwatch.llm.common import ship_code

SPAN = "array<struct<kind:string,start:int,end:int>>"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def fit_in_task(spark: SparkSession, make: Callable, *sample):
    """``make(*sample)`` for a bounded sample in one task: a worker does numpy's small products in one thread, which the
    driver's many threads only slow down; a lost task is run again and gives the same model."""
    ship_code(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"model": [pickle.dumps(make(*pickle.loads(s))) for s in frame["sample"]]})

    return pickle.loads(spark.createDataFrame([(pickle.dumps(sample),)], "sample binary").mapInPandas(run, "model binary").first()[0])


class Adam:
    """Adam steps over a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.w[k].dtype)


def char_codes(texts: list[str], width: int, known: int = 128) -> np.ndarray:
    """Code points below ``known``; other characters as 1, padding as 0."""
    out = np.zeros((len(texts), width), np.int32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t[:width].encode("utf-32-le", "surrogatepass"), "<u4")
        out[i, :len(c)] = np.where(c < known, np.maximum(c, 1), 1)
    return out
