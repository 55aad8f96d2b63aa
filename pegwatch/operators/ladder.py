"""A ladder of logistic models over many folds, fitted together.

Every fold leaves one group out (or is the time split); every model uses a nested group of columns. All share one table. Its
columns are winsorised, filled and standardised with the bounds of the fold that fits them, taken in one pass for all folds. Newton
steps then run for all (model, fold) at once: a task adds up gradients and curvatures of its rows for every fold that the row trains,
the sums of the tasks are added, and only numbers whose count is models x folds x columns squared reach the driver. So the number of
jobs is that of the steps, not of the folds, and no row is copied for a fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.functions.ranks import exact_quantiles
from pegwatch.session import cut, ship_code

STEPS, TOLERANCE = 60, 1e-8


def fold_bounds(rows: DataFrame, cols: Sequence[str], folds: Sequence, lo: float = 0.01, hi: float = 0.99) -> dict[tuple[int, str], dict]:
    """Winsor bounds and medians of each column in the training rows of each fold."""
    keep = F.filter(F.array(*[F.lit(k) for k in range(len(folds))]), lambda k: k != F.col("_fold"))
    values = rows.select("_fold", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["_fold"], list(cols), "measure", "value").where("value is not null")
    # a value's count per fold first, so that only distinct values are copied
    counted = values.groupBy("measure", "value", "_fold").agg(F.count("*").alias("n"))
    spread = counted.withColumn("fold", F.explode(keep)).withColumn("value", F.explode(F.array_repeat("value", F.col("n").cast("int"))))
    q = exact_quantiles(spread, "value", {"lo": lo, "med": 0.5, "hi": hi}, ["fold", "measure"])
    ends = spread.groupBy("fold", "measure").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    found = q.join(ends, ["fold", "measure"]).collect()  # folds x columns rows
    return {(r["fold"], r["measure"]): {"lo": r["lo"] if r["hi"] > r["lo"] else r["mn"], "hi": r["hi"] if r["hi"] > r["lo"] else r["mx"], "med": r["med"]} for r in found}


class Prepared:
    """The columns of one fold as numbers: winsorised, filled, standardised."""

    def __init__(self, cols: Sequence[str], bounds: dict, fold: int):
        mine = [bounds.get((fold, c)) for c in cols]
        self.lo = np.array([b["lo"] if b else -np.inf for b in mine])
        self.hi = np.array([b["hi"] if b else np.inf for b in mine])
        self.med = np.array([b["med"] if b else 0.0 for b in mine])
        self.mean, self.scale = np.zeros(len(cols)), np.ones(len(cols))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(x), self.med, np.clip(x, self.lo, self.hi))
        return (filled - self.mean) / self.scale


def _summed(rows: DataFrame, cols: Sequence[str], y: str, part) -> dict[int, np.ndarray]:
    """Sums over all tasks of ``part(job, x, y, fold)``; each task sends one row for each job."""
    jobs = part.jobs
    ship_code(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            x, target, fold = frame[list(cols)].to_numpy(float), frame[y].to_numpy(float), frame["_fold"].to_numpy()
            for job in range(jobs):
                got = part(job, x, target, fold)
                total[job] = got if job not in total else total[job] + got
        if total:
            yield pd.DataFrame({"job": list(total), "sums": [v.tolist() for v in total.values()]})

    sums = rows.select("_fold", F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(run, "job int, sums array<double>")
    total = sums.select("job", F.posexplode("sums").alias("i", "v")).groupBy("job", "i").agg(F.sum("v").alias("v"))
    packed = total.groupBy("job").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))
    return {r["job"]: np.array(r["v"]) for r in packed.collect()}  # jobs x columns squared numbers


class Moments:
    """Training rows, positives, sums and squares of each fold's prepared columns."""

    def __init__(self, prepared: list[Prepared], fit: list[np.ndarray]):
        self.prepared, self.fit, self.jobs = prepared, fit, len(prepared)

    def __call__(self, job: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        used = self.fit[job][fold]
        z = self.prepared[job](x[used])
        return np.concatenate([[used.sum(), y[used].sum()], z.sum(0), (z * z).sum(0)])


class Step:
    """Loss, gradient and curvature of every (model, fold) at its present weights."""

    def __init__(self, tasks: list[tuple[int, list[int]]], prepared: list[Prepared], fit: list[np.ndarray], weights: list[np.ndarray]):
        self.tasks, self.prepared, self.fit, self.weights, self.jobs = tasks, prepared, fit, weights, len(tasks)

    def __call__(self, job: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        k, cols = self.tasks[job]
        used = self.fit[k][fold]
        z = np.hstack([self.prepared[k](x[used])[:, cols], np.ones((used.sum(), 1))])
        m = z @ self.weights[job]
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        loss = np.logaddexp(0, m) - y[used] * m
        return np.concatenate([[loss.sum(), p.sum()], z.T @ (p - y[used]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


class Ladder:
    """Fitted weights of every (model, fold) and what is needed to score with them."""

    def __init__(self, cols: Sequence[str], models: dict[str, Sequence[str]], folds: Sequence, prepared, tasks, weights, summary):
        self.cols, self.models, self.folds, self.prepared, self.tasks, self.weights, self.summary = list(cols), models, list(folds), prepared, tasks, weights, summary

    def fits(self, spark) -> DataFrame:
        """model, fold, rows_fit, positives, expected (sum of the fitted probabilities), single_class, steps."""
        return spark.createDataFrame(self.summary, "model string, fold string, rows_fit long, positives long, expected double, single_class boolean, steps int")

    def score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep..., model, score: every row by the models of the fold that leaves it out."""
        names, cols, folds, prepared = list(self.models), self.cols, len(self.folds), self.prepared
        by = {(self.tasks[j][0], m): (self.tasks[j][1], self.weights[j]) for j, m in enumerate(n for _ in range(folds) for n in names)}
        kept = rows.select(*keep, "_fold", *[F.col(c).cast("double").alias(f"x_{c}") for c in cols])
        schema = ", ".join([f"`{c}` {dict(rows.dtypes)[c]}" for c in keep] + ["model string", "score double"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x, fold = frame[[f"x_{c}" for c in cols]].to_numpy(float), frame["_fold"].to_numpy()
                for name in names:
                    score = np.full(len(frame), np.nan)
                    for k in np.unique(fold):
                        if k < folds:
                            mine, (used, w) = fold == k, by[k, name]
                            m = np.hstack([prepared[k](x[mine])[:, used], np.ones((mine.sum(), 1))]) @ w if isinstance(w, np.ndarray) else None
                            score[mine] = w if m is None else 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                    yield frame[list(keep)].assign(model=name, score=score)

        return kept.mapInPandas(run, schema)


def tagged(rows: DataFrame, fold_of: str, folds: Sequence) -> DataFrame:
    """The rows with ``_fold``, the number of their group among ``folds``; one past the last for others."""
    number = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold_of)).cast("int") - 1
    return rows.withColumn("_fold", F.when(number < 0, len(folds)).otherwise(F.coalesce(number, F.lit(len(folds)))))


def fit_ladder(rows: DataFrame, models: dict[str, Sequence[str]], y: str, folds: Sequence, C: float = 1.0) -> Ladder:
    """L2-penalised logistic models (C as the inverse penalty of a row) of ``rows`` (tagged): for each fold trained on all other
    rows. Rows without a label are never trained on. A fold with one class only scores its mean."""
    cols = list(dict.fromkeys(c for m in models.values() for c in m))
    rows = cut(rows.where(F.col(y).isNotNull()).select("_fold", y, *cols), "ladder")
    bounds = fold_bounds(rows, cols, folds)
    prepared = [Prepared(cols, bounds, k) for k in range(len(folds))]
    fit = [np.arange(len(folds) + 1) != k for k in range(len(folds))]
    moments = _summed(rows, cols, y, Moments(prepared, fit))
    size = len(cols)
    counts = np.zeros((len(folds), 2))
    for k, m in moments.items():
        n = max(1.0, m[0])
        counts[k] = m[:2]
        mean, square = m[2:2 + size] / n, m[2 + size:] / n
        spread = np.sqrt(np.maximum(square - mean**2, 0))
        prepared[k].mean, prepared[k].scale = mean, np.where(spread > 1e-12 * np.maximum(1, np.abs(mean)), spread, 1.0)
    tasks = [(k, [cols.index(c) for c in m]) for k in range(len(folds)) for m in models.values()]
    weights: list = [np.zeros(len(c) + 1) for _, c in tasks]
    one = [counts[k][0] == 0 or counts[k][1] in (0, counts[k][0]) for k, _ in tasks]
    done, steps, loss, last = list(one), [0] * len(tasks), [np.inf] * len(tasks), [None] * len(tasks)
    expected = [float(counts[k][1]) for k, _ in tasks]
    for _ in range(STEPS):
        open_ = [j for j, d in enumerate(done) if not d]
        if not open_:
            break
        sums = _summed(rows, cols, y, Step([tasks[j] for j in open_], prepared, fit, [weights[j] for j in open_]))
        for i, j in enumerate(open_):
            s, width = sums[i], len(weights[j])
            ridge = np.r_[np.full(width - 1, 1.0 / C), 0.0]
            now = s[0] + 0.5 * (ridge * weights[j] ** 2).sum()
            expected[j], steps[j] = float(s[1]), steps[j] + 1
            if now > loss[j] + 1e-9 * abs(loss[j]):  # too far: half the step
                weights[j] = (weights[j] + last[j]) / 2
                continue
            gradient = s[2:2 + width] + ridge * weights[j]
            if np.abs(gradient).max() <= TOLERANCE * max(1.0, counts[tasks[j][0]][0]):
                done[j] = True
                continue
            curvature = s[2 + width:].reshape(width, width) + np.diag(ridge + 1e-12)
            loss[j], last[j] = now, weights[j]
            weights[j] = weights[j] - np.linalg.solve(curvature, gradient)
    names = list(models)
    summary = []
    for j, (k, _) in enumerate(tasks):
        n, hits = counts[k]
        if one[j]:
            weights[j] = float(hits / n) if n else float("nan")
        summary.append((names[j % len(names)], str(folds[k]), int(n), int(hits), expected[j], bool(one[j]), steps[j]))
    return Ladder(cols, models, folds, prepared, tasks, weights, summary)


def fold_names(rows: DataFrame, fold_of: str) -> list:
    """The groups that are left out in turn; a model's folds, so few."""
    return sorted(r[0] for r in rows.where(F.col(fold_of).isNotNull()).select(fold_of).distinct().collect())
