"""Cluster bootstraps and replicated labels.

Draws come from MD5 hashes of (seed, draw, slot), so every re-run and every engine resamples the same clusters. Data is
summed per cluster (or per cluster and score) before it meets the draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegwatch.functions.ranks import by_range, dense_index
from pegwatch.functions.scalars import hash_uniform, hour_keys
from pegwatch.operators.metrics import ap_from_counts
from pegwatch.operators.tables import candidates
from pegwatch.rules import DAY


def draw_weights(rows: DataFrame, cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, cluster, weight): clusters drawn with replacement, as many as there are. Each cluster is also one slot of
    every draw, so the draws need no table of their own."""
    ids = dense_index(rows, cluster, "idx")
    slots = ids.select("n_idx", "idx", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.floor(hash_uniform(F.lit(seed), "draw", "idx") * F.col("n_idx")).cast("bigint")
    weights = slots.select("draw", pick.alias("idx")).groupBy("draw", "idx").agg(F.count("*").alias("weight"))
    return weights.join(ids.select(cluster, "idx"), "idx").select("draw", cluster, "weight")


def interval(draws: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval and share above zero over the draws."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(q.alias("_q"), F.avg((F.col(value) > 0).cast("double")).alias("share_above_0"), F.count(value).alias("draws")).select(
        *by, F.element_at("_q", 1).alias("low"), F.element_at("_q", 2).alias("high"), "share_above_0", "draws")


def bootstrap_mean(rows: DataFrame, cluster: str, value: str, draws: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``value`` per group with a cluster bootstrap interval."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = draw_weights(rows, cluster, draws, seed)
    each = sums.join(w, cluster).groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("weight") * F.col("_s")), F.sum(F.col("weight") * F.col("_n"))).alias("_m"))
    point = rows.groupBy(*by).agg(F.avg(value).alias("mean"))
    out = interval(each, "_m", by)
    return point.join(out, list(by)) if by else point.withColumn("_i", out.select(F.struct("*").alias("_i")).scalar()).select("mean", "_i.*")


def weight_matrix(rows: DataFrame, cluster: str, draws: int, seed: int, most: int) -> tuple[list, np.ndarray] | None:
    """The clusters and their weights (clusters by draws), or None if that is more than ``most`` cells."""
    ids = rows.select(cluster).distinct()
    if ids.count() * draws > most:
        return None
    w = draw_weights(rows, cluster, draws, seed).groupBy(cluster).agg(F.collect_list("draw").alias("d"), F.collect_list("weight").alias("w")).collect()
    names = sorted(r[0] for r in ids.collect())
    place = {c: i for i, c in enumerate(names)}
    out = np.zeros((len(names), draws))
    for r in w:
        out[place[r[0]], r["d"]] = r["w"]
    return names, out


def bootstrap_ap(rows: DataFrame, cluster: str, draws: int, seed: int = 0, by: Sequence[str] = (), y: str = "y", score: str = "score",
                 most: int = 20_000_000) -> DataFrame:
    """Average precision of every draw: rows are counted per (group, cluster, score) once and dealt by ranges of the score.

    A range keeps one running sum per draw, so rows are never copied for the draws; only the totals of the ranges, one
    array each, leave a task. Beyond ``most`` weights the counts are joined with the draws instead.
    """
    counts = rows.groupBy(*by, cluster, F.col(score).cast("double").alias("_s")).agg(F.count("*").cast("double").alias("_c"), F.sum(y).cast("double").alias("_p"))
    found = weight_matrix(rows, cluster, draws, seed, most)
    if found is None:
        weighted = counts.join(draw_weights(rows, cluster, draws, seed), cluster).groupBy(*by, "draw", "_s").agg(
            F.sum(F.col("weight") * F.col("_c")).alias("_n"), F.sum(F.col("weight") * F.col("_p")).alias("_tp"))
        return ap_from_counts(weighted, [*by, "draw"]).select(*by, "draw", "ap")
    names, matrix = found
    shared = rows.sparkSession.sparkContext.broadcast(({c: i for i, c in enumerate(names)}, matrix))
    by = list(by)
    ranges = by_range(counts, ["_s", *by])
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.select(*by).schema.fields) + (", " if by else "")
    arrays = "n array<double>, p array<double>"

    def weights(part):
        place, w = shared.value
        return w[[place[c] for c in part[cluster]]]

    def total(part):
        w = weights(part)
        return part[[*by, "_bucket"]].head(1).assign(n=[part["_c"].to_numpy() @ w], p=[part["_p"].to_numpy() @ w])

    def above(part):
        """What the ranges of greater scores hold, and the positives of all of them."""
        part = part.sort_values("_bucket", ascending=False)
        n, p = np.stack(part["n"]), np.stack(part["p"])
        return part[[*by, "_bucket"]].assign(n=list(np.cumsum(n, 0) - n), p=list(np.cumsum(p, 0) - p), all=[p.sum(0)] * len(part))

    def gain(part, before):
        """The range's share of the average precision of every draw."""
        part = part.sort_values("_s", ascending=False)
        n, p, every = (np.array(before[c].iloc[0]) for c in ("n", "p", "all"))
        starts = np.flatnonzero(np.r_[True, np.diff(part["_s"].to_numpy()) != 0])
        area = np.zeros(len(n))
        for at in np.array_split(starts, max(1, len(part) // 2048)):  # whole scores at a time, so memory is bounded
            if not len(at):
                continue
            end = starts[np.searchsorted(starts, at[-1]) + 1] if at[-1] != starts[-1] else len(part)
            some = part.iloc[at[0]:end]
            w = weights(some)
            cn = n + np.cumsum(np.add.reduceat(some["_c"].to_numpy()[:, None] * w, at - at[0], 0), 0)
            tp = np.add.reduceat(some["_p"].to_numpy()[:, None] * w, at - at[0], 0)
            cp = p + np.cumsum(tp, 0)
            area += (tp * cp / np.maximum(cn, 1e-300)).sum(0)
            n, p = cn[-1], cp[-1]
        return part[by].head(1).assign(n=[n], p=[every], area=[area])

    keys = [*by, "_bucket"]
    offsets = ranges.groupBy(*keys).applyInPandas(total, f"{key}_bucket int, {arrays}").groupBy(*by).applyInPandas(above, f"{key}_bucket int, {arrays}, all array<double>")
    parts = ranges.groupBy(*keys).cogroup(offsets.groupBy(*keys)).applyInPandas(gain, f"{key}{arrays}, area array<double>")

    def finish(part):
        n, p, area = np.stack(part["n"]).max(0), part["p"].iloc[0], np.stack(part["area"]).sum(0)
        drawn = np.flatnonzero(n > 0)
        ap = [float(area[d] / p[d]) if p[d] > 0 else None for d in drawn]
        return pd.DataFrame({**{c: [part[c].iloc[0]] * len(drawn) for c in by}, "draw": drawn, "ap": ap})

    return parts.groupBy(*by).applyInPandas(finish, f"{key}draw int, ap double")


def paired_ap(a: DataFrame, b: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Difference in average precision of two scores of the same (symbol, ts) rows with its asset-block interval."""
    both = a.select("symbol", "ts", "y", F.col("score").alias("sa")).join(b.select("symbol", "ts", F.col("score").alias("sb")), ["symbol", "ts"])
    long = both.select("symbol", "y", F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col("sa").alias("score")), F.struct(F.lit("b").alias("m"), F.col("sb").alias("score")))).alias("v"))
    long = long.select("symbol", "y", "v.m", "v.score")
    each = bootstrap_ap(long, "symbol", draws, seed, ["m"])
    side = lambda m: F.max(F.when(F.col("m") == m, F.col("ap")))
    diffs = each.groupBy("draw").agg((side("a") - side("b")).alias("d")).filter("d is not null")
    from pegwatch.operators.metrics import average_precision
    point = average_precision(long, ["m"]).agg(side("a").alias("ap_a"), side("b").alias("ap_b"), F.max("rows").cast("bigint").alias("rows"), F.max("positives").cast("bigint").alias("positives"))
    return point.withColumn("diff", F.col("ap_a") - F.col("ap_b")).withColumn("_i", interval(diffs, "d").select(F.struct("*").alias("_i")).scalar()).select(
        "rows", "positives", "ap_a", "ap_b", "diff", "_i.*")


def one_to_one(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row counts behind a pairing: matched keys, keys on one side only, and repeated keys (must be zero)."""
    both = a.groupBy(*key).agg(F.count("*").alias("_a")).join(b.groupBy(*key).agg(F.count("*").alias("_b")), list(key), "full")
    has_a, has_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(
        F.count(F.when(has_a & has_b, 1)).alias("matched"), F.count(F.when(has_a & ~has_b, 1)).alias("only_a"), F.count(F.when(~has_a & has_b, 1)).alias("only_b"),
        F.count(F.when((F.col("_a") > 1) | (F.col("_b") > 1), 1)).alias("repeated"))


def link_rates(pairs: DataFrame, linked: Column, y: str, draws: int, seed: int = 0) -> DataFrame:
    """Follow rate of linked and unlinked pairs and their difference with a seed-cluster interval."""
    rows = pairs.filter(F.col(y).isNotNull()).withColumn("_l", linked)
    part = lambda flag, c: F.sum(F.when(flag, c).otherwise(0))
    yes, no = F.col("_l"), ~F.col("_l")
    sums = rows.groupBy("cluster").agg(part(yes, F.col(y)).alias("sl"), part(yes, F.lit(1)).alias("nl"), part(no, F.col(y)).alias("su"), part(no, F.lit(1)).alias("nu"))
    w = draw_weights(rows, "cluster", draws, seed)
    rate = lambda s, n: F.try_divide(F.sum(F.col("weight") * F.col(s)), F.sum(F.col("weight") * F.col(n)))
    each = sums.join(w, "cluster").groupBy("draw").agg((rate("sl", "nl") - rate("su", "nu")).alias("d")).filter("d is not null")
    point = sums.agg(F.sum("nl").alias("linked_pairs"), F.sum("sl").alias("linked_followers"), F.try_divide(F.sum("sl"), F.sum("nl")).alias("rate_linked"),
                     F.try_divide(F.sum("su"), F.sum("nu")).alias("rate_unlinked"))
    return point.withColumn("difference", F.col("rate_linked") - F.col("rate_unlinked")).withColumn(
        "_i", interval(each, "d").select(F.struct("*").alias("_i")).scalar()).select("linked_pairs", "linked_followers", "rate_linked", "rate_unlinked", "difference", "_i.low", "_i.high", "_i.draws")


def placebo_pairs(seed_rows: DataFrame, eps: DataFrame, dev: DataFrame, shifts: Sequence[int], y: str = "y168") -> DataFrame:
    """Candidate pairs at decision hours moved by whole days, with whether the moved hour was calm."""
    moved = seed_rows.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("tau", F.col("tau") + F.col("shift") * DAY)
    rows = candidates(moved, eps, dev).filter(F.col(y).isNotNull())
    busy = seed_rows.select("tau").distinct().select(hour_keys(F.col("tau") - 7 * DAY, F.col("tau") + 7 * DAY).alias("tau")).distinct().withColumn("_busy", F.lit(True))
    return rows.join(busy, "tau", "left").withColumn("calm", F.col("_busy").isNull()).drop("_busy")


def placebo_rates(actual: DataFrame, placebo: DataFrame, draws: int, y: str = "y168", seed: int = 0) -> DataFrame:
    """Follow rate against every placebo subset: difference and ratio with seed-cluster intervals."""
    subset = F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("calm"), "calm").otherwise("near"), F.when(F.col("shift") < 0, "before").otherwise("after")))).alias("subset")
    p = placebo.select("cluster", y, subset).groupBy("subset", "cluster").agg(F.sum(y).alias("sp"), F.count("*").alias("np"))
    a = actual.groupBy("cluster").agg(F.sum(y).alias("sa"), F.count("*").alias("na"))
    names = p.select("subset").distinct()
    w = draw_weights(actual, "cluster", draws, seed)
    # every subset is compared with all actual clusters, also those without a placebo pair in it
    base = a.join(w, "cluster").groupBy("draw").agg(F.sum(F.col("weight") * F.col("sa")).alias("sa"), F.sum(F.col("weight") * F.col("na")).alias("na"))
    moved = p.join(w, "cluster").groupBy("subset", "draw").agg(F.sum(F.col("weight") * F.col("sp")).alias("sp"), F.sum(F.col("weight") * F.col("np")).alias("np"))
    every = base.withColumn("subset", F.explode(F.array(*[F.lit(s) for s in ("all", "calm", "near", "before", "after")]))).join(names, "subset", "left_semi")
    each = every.join(moved, ["subset", "draw"], "left").withColumn("fa", F.try_divide("sa", "na")).withColumn(
        "fp", F.coalesce("sp", F.lit(0)) / F.greatest(F.coalesce("np", F.lit(0)), F.lit(1))).withColumn("d", F.col("fa") - F.col("fp")).withColumn(
        "r", F.when(F.col("fp") > 0, F.try_divide("fa", "fp")))
    ci = each.groupBy("subset").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("_d"), F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("_r"),
                                    F.avg((F.col("d") <= 0).cast("double")).alias("share_le_0"))
    total = actual.agg(F.avg(F.col(y).cast("double"))).scalar()
    point = p.groupBy("subset").agg(F.sum("np").alias("placebo_pairs"), F.sum("sp").alias("placebo_followers")).withColumn("follow_rate", total)
    rate = F.try_divide("placebo_followers", "placebo_pairs")
    return point.join(ci, "subset").select(
        "subset", "placebo_pairs", "placebo_followers", "follow_rate", rate.alias("placebo_rate"), (F.col("follow_rate") - rate).alias("diff"),
        F.try_divide(F.col("follow_rate"), rate).alias("ratio"), F.element_at("_d", 1).alias("diff_low"), F.element_at("_d", 2).alias("diff_high"),
        F.element_at("_r", 1).alias("ratio_low"), F.element_at("_r", 2).alias("ratio_high"), "share_le_0")
