"""Boosted trees with rounds and leaf size chosen on validation, scored from flat node tables.

A fitted ensemble is read from its own saved node table and kept as arrays (feature, threshold, children, value of every node). A batch walks
all trees level by level as array look-ups, so the margins after every prefix of rounds come out of one pass over the rows, whatever the
number of trees: no column and no projection for a tree. Scores equal the ensemble's own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.operators.metrics import average_precision
from pegwatch.session import cut, shared_folder, ship_code


class FlatTrees:
    """All trees of an ensemble as arrays over their nodes; leaves point at themselves."""

    def __init__(self, nodes: Sequence[tuple], weights: Sequence[float]):
        """``nodes``: (tree, id, feature, threshold, left, right, value), feature -1 for a leaf."""
        table = np.array(sorted(nodes), float)
        tree, at = table[:, 0].astype(int), table[:, 1].astype(int)
        start = np.searchsorted(tree, np.arange(len(weights)))
        leaf = table[:, 2] < 0
        own = np.arange(len(table))
        self.roots, self.weights = start, np.asarray(weights, float)
        self.feature = np.where(leaf, 0, table[:, 2]).astype(int)
        self.threshold = np.where(leaf, np.inf, table[:, 3])
        self.left = np.where(leaf, own, start[tree] + table[:, 4].astype(int))
        self.right = np.where(leaf, own, start[tree] + table[:, 5].astype(int))
        self.value = table[:, 6]
        if not (at == own - start[tree]).all():
            raise ValueError("nodes of a tree are not numbered from 0")
        self.depth, level = 0, self.roots
        while not leaf[level].all():
            level = np.unique(np.concatenate([self.left[level], self.right[level]]))
            self.depth += 1

    @classmethod
    def of(cls, model: GBTClassificationModel, spark) -> FlatTrees:
        """From the model's saved node table: trees x nodes rows, read once."""
        path = f"{shared_folder(spark)}/models/trees-{uuid.uuid4().hex}"
        model.write().save(path)
        n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
        threshold = F.get("split.leftCategoriesOrThreshold", F.lit(0))
        rows = n.select("treeID", "id", F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).otherwise(-1), F.when(F.col("leftChild") >= 0, threshold).otherwise(0.0), "leftChild", "rightChild", "prediction")
        return cls([tuple(r) for r in rows.collect()], list(model.treeWeights))

    def margins(self, x: np.ndarray, rounds: Sequence[int]) -> np.ndarray:
        """(rows, rounds): the margin after each of the given numbers of trees."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        summed = np.cumsum(self.value[node] * self.weights, axis=1)
        return summed[:, np.asarray(rounds) - 1]


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2.0 * np.clip(margin, -300, 300)))


def boosted(train: DataFrame, valid: DataFrame, cols: Sequence[str], y: str, seeds: Sequence[int] = tuple(range(5)), leaves: Sequence[int] = (20, 50, 100, 200),
            rounds: int = 300, every: int = 10, depth: int = 5, threads: int = 4):
    """For each leaf size and seed the number of rounds with the best validation average precision; then the leaf size whose
    scores, averaged over the seeds, are best on validation. Returns a function that scores a table and has ``leaf``, ``rounds`` and
    ``valid_ap`` (average precision for each leaf size). Columns must be prepared (no missing values)."""
    spark = train.sparkSession
    ship_code(spark)
    tr = cut(VectorAssembler(inputCols=list(cols), outputCol="features").transform(train).select("features", F.col(y).cast("double").alias(y)), "trees-train")
    va = cut(valid.select(F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in cols]), "trees-valid")

    def fit(task: tuple[int, int]) -> FlatTrees:
        leaf, seed = task
        gbt = GBTClassifier(labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=0.05, minInstancesPerNode=leaf, subsamplingRate=0.8, seed=seed)
        return FlatTrees.of(gbt.fit(tr), spark)

    tasks = [(leaf, seed) for leaf in leaves for seed in seeds]
    with ThreadPoolExecutor(threads) as pool:  # fits share the cluster
        flat = dict(zip(tasks, pool.map(fit, tasks), strict=True))
    steps = {t: sorted({*range(every, len(f.roots) + 1, every), len(f.roots)}) for t, f in flat.items()}

    def staged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[list(cols)].to_numpy(float)
            for (leaf, seed), f in flat.items():
                m = f.margins(x, steps[leaf, seed])
                for i, step in enumerate(steps[leaf, seed]):
                    yield pd.DataFrame({"leaf": leaf, "seed": seed, "round": step, y: frame[y], "score": m[:, i]})

    every_ap = average_precision(va.mapInPandas(staged, f"leaf int, seed int, round int, `{y}` double, score double"), ["leaf", "seed", "round"], y)
    best: dict[tuple[int, int], tuple] = {}
    for r in every_ap.collect():  # a row for each fit and step
        order = (-(r["ap"] if r["ap"] is not None else -1.0), r["round"])
        best[r["leaf"], r["seed"]] = min(order, best.get((r["leaf"], r["seed"]), order))
    chosen = {t: best[t][1] if t in best else steps[t][-1] for t in tasks}

    def averaged(x: np.ndarray, leaf: int) -> np.ndarray:
        return np.mean([chance(flat[leaf, s].margins(x, [chosen[leaf, s]])[:, 0]) for s in seeds], axis=0)

    def by_leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[list(cols)].to_numpy(float)
            for leaf in leaves:
                yield pd.DataFrame({"leaf": leaf, y: frame[y], "score": averaged(x, leaf)})

    valid_ap = {r["leaf"]: r["ap"] for r in average_precision(va.mapInPandas(by_leaf, f"leaf int, `{y}` double, score double"), ["leaf"], y).collect()}
    leaf = max(leaves, key=lambda k: (valid_ap.get(k) if valid_ap.get(k) is not None else -1.0, -k))

    def score(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep..., score, of every row."""
        kept = df.select(*keep, *[F.col(c).cast("double").alias(f"_x_{c}") for c in cols])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[list(keep)].assign(score=averaged(frame[[f"_x_{c}" for c in cols]].to_numpy(float), leaf))

        return kept.mapInPandas(run, ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep) + ", score double")

    score.leaf, score.rounds, score.valid_ap = leaf, [chosen[leaf, s] for s in seeds], valid_ap
    return score
