"""Ranking and event metrics of scored rows.

Ranks come from ``functions.ranks``: rows are counted per distinct score first, and the running sums are split over
score buckets, so no metric sorts a table, or a hot group of it, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.functions.ranks import exact_quantiles, running_totals, top_rows
from pegwatch.operators.series import ordered
from pegwatch.rules import DAY, HOUR, SEVERE


def score_counts(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(w).alias("_n"), F.sum(w * F.col(y)).alias("_tp"))


def ap_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    run = running_totals(counts.filter("_n > 0"), "_s", ["_n", "_tp"], by, descending=True)
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_tp") * F.col("cum__tp") / F.col("cum__n")), F.max("all__tp")).alias("ap"),
        F.max("all__n").alias("rows"), F.max("all__tp").alias("positives"))


def average_precision(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """Tie-aware average precision per group: precision at the last row of each score, weighted by its positives."""
    return ap_from_counts(score_counts(df, by, y, score, weight), by)


def auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """ROC area by mid-ranks."""
    counts = score_counts(df, by, y, score).withColumn("_neg", F.col("_n") - F.col("_tp"))
    run = running_totals(counts, "_s", ["_neg", "_tp"], by)
    below = F.col("cum__neg") - F.col("_neg")
    return run.groupBy(*by).agg(F.try_divide(
        F.sum(F.col("_tp") * (below + F.col("_neg") / 2)), F.max("all__neg") * F.max("all__tp")).alias("auc"))


def brier(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))


def asset_ap(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the per-asset average precisions over assets with both outcomes."""
    per = average_precision(df, [*by, "symbol"]).filter("positives > 0 and positives < rows")
    return per.groupBy(*by).agg(F.avg("ap").alias("asset_ap"), F.count("*").alias("assets"))


def exposed_ap(df: DataFrame, by: Sequence[str], least: int = 10) -> DataFrame:
    """Average precision on exposed and unexposed rows, where there are enough positives."""
    part = df.withColumn("part", F.when(F.col("has_exposure") > 0, "exposed").otherwise("unexposed"))
    out = average_precision(part, [*by, "part"])
    return out.withColumn("ap", F.when((F.col("positives") >= least) & (F.col("positives") < F.col("rows")), F.col("ap")))


def top_alerts(df: DataFrame, by: Sequence[str] = (), share: float = 0.05) -> DataFrame:
    """Flags exactly the top share of rows; ties go by time, then symbol."""
    return top_rows(df, [("score", True), ("ts", False), ("symbol", False)], share=share, by=by, flag="alert")


def thresholds(valid: DataFrame, by: Sequence[str], budgets: Sequence[float]) -> DataFrame:
    """Score quantiles of validation rows, one column per alert budget."""
    return exact_quantiles(valid, "score", {f"thr_{i}": 1 - b for i, b in enumerate(budgets)}, by)


def episode_windows(eps: DataFrame, h: int) -> DataFrame:
    return eps.select("symbol", "t0", F.col("severity").isin(*SEVERE).alias("severe"),
                      S.hour_keys(F.col("t0") - h * HOUR, F.col("t0") - HOUR).alias("ts"))


def episode_hits(rows: DataFrame, eps: DataFrame, h: int, by: Sequence[str] = ()) -> DataFrame:
    """Per episode with at least one row in its warning window: rows in it, whether one alerts, and the lead."""
    joined = episode_windows(eps, h).join(rows.select(*by, "symbol", "ts", "alert"), ["symbol", "ts"])
    first = F.min(F.when(F.col("alert"), F.col("ts")))
    return joined.groupBy(*by, "symbol", "t0", "severe").agg(
        F.count("*").alias("w"), F.coalesce(F.bool_or("alert"), F.lit(False)).alias("caught"), first.alias("first_alert"),
    ).withColumn("lead_h", (F.col("t0") - F.col("first_alert")) / HOUR)


def events(rows: DataFrame, eps: DataFrame, h: int, by: Sequence[str]) -> DataFrame:
    """Event recall, severe recall, alert precision and rate, median lead."""
    hits = episode_hits(rows, eps, h, by).groupBy(*by).agg(
        F.count("*").alias("episodes"), F.avg(F.col("caught").cast("double")).alias("event_recall"),
        F.count(F.when(F.col("severe"), 1)).alias("severe_episodes"),
        F.avg(F.when(F.col("severe"), F.col("caught").cast("double"))).alias("severe_recall"),
        F.percentile("lead_h", 0.5).alias("median_lead_h"))
    rates = rows.groupBy(*by).agg(
        F.avg(F.col("alert").cast("double")).alias("alert_rate"), F.avg(F.when(F.col("alert"), F.col("y").cast("double"))).alias("alert_precision"))
    return rates.join(hits, list(by), "left")


# ------------------------------------------------------------------------------------------------ alert runs
def runs(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive alerted hours of one asset, with whether one of them is positive."""
    w = ordered([*by, "symbol"])
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) != HOUR).cast("int"), F.lit(1))
    rid = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return alerts.withColumn("_new", new).withColumn("_rid", rid).groupBy(*by, "symbol", "_rid").agg(
        F.min("ts").alias("start"), F.count("*").alias("hours"), F.max("y").alias("y")).drop("_rid")


def run_summary(alerts: DataFrame, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs, runs a day over the days of ``rows`` and the share of runs with a positive hour."""
    day = F.floor(F.col("ts") / DAY)
    days = rows.agg(F.count_distinct(day)).scalar()
    return runs(alerts, by).groupBy(*by).agg(F.count("*").alias("runs"), F.sum("y").cast("bigint").alias("runs_with_start")).withColumn(
        "_days", days).select(*by, "runs", "runs_with_start", (F.col("runs") / F.col("_days")).alias("runs_per_day"),
                              F.try_divide("runs_with_start", "runs").alias("run_precision"))


def random_runs(rows: DataFrame, share: float, draws: int, seed: int = 0) -> DataFrame:
    """Alert runs of rows drawn at random without replacement: the k smallest hashes of each draw."""
    many = rows.select("symbol", "ts", "y", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    many = many.withColumn("_u", S.hash_uniform(F.lit(seed), "draw", "symbol", "ts"))
    picked = top_rows(many, [("_u", False), ("ts", False), ("symbol", False)], share=share, by=["draw"]).filter("top")
    return run_summary(picked, rows, ["draw"])


def monitor(alerts: DataFrame, rows: DataFrame) -> DataFrame:
    """Alerts, new runs and alerted assets a day."""
    day = F.floor(F.col("ts") / DAY)
    days = rows.agg(F.count_distinct(day)).scalar()
    n_runs = runs(alerts).agg(F.count("*")).scalar()
    asset_days = alerts.select(day.alias("d"), "symbol").distinct().agg(F.count("*")).scalar()
    return alerts.agg(F.count("*").alias("alerts")).select(
        "alerts", days.alias("days")).withColumn("alerts_per_day", F.col("alerts") / F.col("days")).withColumn("_r", n_runs).withColumn(
        "_a", asset_days).select("alerts", "days", "alerts_per_day", F.col("_r").alias("runs"), (F.col("_r") / F.col("days")).alias("runs_per_day"),
                                 (F.col("_a") / F.col("days")).alias("assets_per_day"))


def lead_curve(hits: DataFrame, by: Sequence[str], kmax: int = 72) -> DataFrame:
    """Share of episodes alerted at least k hours ahead, k = 1 to ``kmax``."""
    ks = hits.groupBy(*by).agg(F.count("*").alias("episodes")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax))))
    lead = F.least(F.floor("lead_h"), F.lit(kmax)).cast("int")
    reached = hits.filter("lead_h >= 1").select(*by, F.explode(F.sequence(F.lit(1), lead)).alias("k")).groupBy(*by, "k").agg(F.count("*").alias("_c"))
    return ks.join(reached, [*by, "k"], "left").select(*by, "k", "episodes", (F.coalesce("_c", F.lit(0)) / F.col("episodes")).alias("share"))


def overtaking_hour(curve: DataFrame, ahead: str, behind: str, by: str = "model") -> DataFrame:
    """First lead from which one model stays above another up to the longest lead."""
    a = curve.filter(F.col(by) == ahead).select("k", F.col("share").alias("_a"))
    b = curve.filter(F.col(by) == behind).select("k", F.col("share").alias("_b"))
    return a.join(b, "k").agg((F.coalesce(F.max(F.when(F.col("_a") <= F.col("_b"), F.col("k"))), F.lit(0)) + 1).alias("_k"), F.max("k").alias("_m")).select(
        F.lit(ahead).alias("ahead"), F.lit(behind).alias("behind"), F.when(F.col("_k") <= F.col("_m"), F.col("_k")).alias("from_hour"))


def repeats(hits: DataFrame, eps: DataFrame, by: Sequence[str], days: int = 7) -> DataFrame:
    """Recall on episodes that start within a week of the previous one's end, and on the others."""
    prev = F.max("t1").over(Window.partitionBy("symbol").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1))
    tagged = eps.select("symbol", "t0", F.coalesce(F.col("t0") - prev <= days * DAY, F.lit(False)).alias("repeat"))
    return hits.join(tagged, ["symbol", "t0"]).groupBy(*by, "repeat").agg(
        F.count("*").alias("episodes"), F.count(F.when(F.col("caught"), 1)).alias("caught"))


def close_visibility(eps: DataFrame, dev: DataFrame) -> DataFrame:
    """Episodes that no daily close shows at or beyond the threshold, by severity."""
    closes = dev.filter(F.col("ts") % DAY == 0).select("symbol", "ts", (F.col("dev") <= -F.col("theta")).alias("_b"))
    first = (F.ceil(F.col("t0") / DAY) * DAY).cast("bigint")
    seen = eps.select("symbol", "t0", S.hour_keys(first, F.col("t1"), DAY).alias("ts")).join(closes, ["symbol", "ts"]).groupBy("symbol", "t0").agg(
        F.bool_or("_b").alias("_seen"))
    rows = eps.select("symbol", "t0", F.col("severity").isin(*SEVERE).alias("severe")).join(seen, ["symbol", "t0"], "left")
    unseen = ~F.coalesce("_seen", F.lit(False))
    return rows.groupBy("severe").agg(F.count("*").alias("episodes"), F.count(F.when(unseen, 1)).alias("unseen"), F.avg(unseen.cast("double")).alias("unseen_share"))


# ------------------------------------------------------------------------------------------------ chance and stakes
def random_recall(hits: DataFrame, rows: DataFrame, by: Sequence[str], share: float = 0.05) -> DataFrame:
    """Chance of each episode to be met by the same number of alerts at random, and the mean."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    each = hits.join(n, list(by)).withColumn("k", F.bround(F.lit(share) * F.col("n")))
    return each.withColumn("p_random", S.hit_probability("w", "k", "n"))


def expected_runs(rows: DataFrame, by: Sequence[str], share: float = 0.05) -> DataFrame:
    """Expected runs of k random alerts: k less the chance that neighbouring hours are both drawn."""
    adjacent = (F.col("ts") - F.lag("ts").over(ordered([*by, "symbol"])) == HOUR).cast("int")
    n = F.col("n").cast("double")
    k = F.bround(F.lit(share) * F.col("n"))
    return rows.withColumn("_adj", adjacent).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("_adj"), F.lit(0)).alias("adjacent")).select(
        *by, "n", "adjacent", k.cast("bigint").alias("k"), (k - F.col("adjacent") * k * (k - 1) / (n * (n - 1))).alias("expected_runs"))


def at_stake(hits: DataFrame, exposures: DataFrame, measure: str) -> DataFrame:
    """Collateral behind each episode one hour before it starts (missing means none)."""
    at = exposures.select("symbol", (F.col("ts") + HOUR).alias("t0"), F.col(measure).alias("collateral"))
    return hits.join(at, ["symbol", "t0"], "left").withColumn("collateral", F.coalesce("collateral", F.lit(0.0)))


def stake_summary(rows: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """Recall weighted by collateral, recall with and without collateral, and how concentrated it is."""
    c, hit = F.col("collateral"), F.col("caught")
    top = top_rows(rows, [("collateral", True), ("symbol", False), ("t0", False)], k=F.lit(5), by=by, flag="_top5")
    return top.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count(F.when(c >= least, 1)).alias("with_collateral"), F.sum(c).alias("collateral_total"),
        F.try_divide(F.sum(F.when(hit, c).otherwise(0.0)), F.sum(c)).alias("weighted_recall"),
        F.avg(F.when(c >= least, hit.cast("double"))).alias("recall_with"), F.avg(F.when(c < least, hit.cast("double"))).alias("recall_without"),
        F.try_divide(F.sum(F.when(hit & F.col("severe"), c).otherwise(0.0)), F.sum(F.when(F.col("severe"), c))).alias("severe_weighted_recall"),
        F.try_divide(F.max(c), F.sum(c)).alias("top1_share"), F.try_divide(F.sum(F.when(F.col("_top5"), c)), F.sum(c)).alias("top5_share"))


def largest(rows: DataFrame, k: int = 8) -> DataFrame:
    return rows.orderBy(F.desc("collateral"), "symbol", "t0").limit(k)


def deepest_share(table: DataFrame, share: float = 0.2) -> DataFrame:
    """Flags the deepest fifth of decision rows, ties by id."""
    return top_rows(table.withColumn("depth_frac", F.coalesce("depth_frac", F.lit(-1.0))), [("depth_frac", True), ("episode_id", False)], share=share, flag="deepest")


def earlier_cut(table: DataFrame, earlier: Column, prob: float = 0.8) -> DataFrame:
    """The other depth flag: at or beyond a quantile of earlier episodes."""
    cut = exact_quantiles(table.filter(earlier), "depth_frac", {"cut": prob}).select("cut").scalar()
    return table.filter(~earlier).withColumn("cut", cut).withColumn("flag", F.coalesce(F.col("depth_frac") >= F.col("cut"), F.lit(False)))


# ------------------------------------------------------------------------------------------------ pair rankings
def ranking(pairs: DataFrame, by: Sequence[str], y: str = "y168", k: int = 5, n: int = 10) -> DataFrame:
    """Per seed with a follower: average precision, precision and hit in the top k, discounted gain in the top n.
    ``score`` must already carry its tie-breaker. One seed ranks each asset once."""
    keys = [*by, "seed_id"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "cand"))
    gains = [0.0]
    from math import log2
    for i in range(n):
        gains.append(gains[-1] + 1 / log2(i + 2))
    ideal = F.element_at(F.array(*[F.lit(g) for g in gains]), (F.least(F.col("followers"), F.lit(n)) + 1).cast("int"))
    gain = F.when(F.col("_r") <= n, F.col(y) / F.log2(F.col("_r") + 1)).otherwise(0.0)
    per = pairs.withColumn("_r", rank).groupBy(*keys).agg(
        F.min("cluster").alias("cluster"), F.count("*").alias("candidates"), F.sum(y).alias("followers"),
        F.sum(F.when(F.col("_r") <= k, F.col(y))).alias("_top"), F.sum(gain).alias("_gain")).filter("followers > 0")
    out = per.select(*keys, "cluster", "candidates", "followers", (F.col("_top") / F.least(F.lit(k), F.col("candidates"))).alias("p5"),
                     (F.col("_top") > 0).cast("double").alias("hit5"), (F.col("_gain") / ideal).alias("ndcg10"))
    ap = average_precision(pairs, keys, y).select(*keys, "ap")
    return out.join(ap, keys)


def with_jitter(pairs: DataFrame, score) -> DataFrame:
    return pairs.withColumn("score", score + S.tie_jitter("seed_id", "cand"))


def random_ranking(pairs: DataFrame, draws: int, y: str = "y168", seed: int = 0) -> DataFrame:
    """The same per-seed metrics for random scores, averaged over draws."""
    many = pairs.select("seed_id", "cand", "cluster", y, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn(
        "score", S.hash_uniform(F.lit(seed), "draw", "seed_id", "cand"))
    return ranking(many, ["draw"], y).groupBy("seed_id").agg(*[F.avg(c).alias(c) for c in ("ap", "p5", "hit5", "ndcg10")])


def case_studies(pairs: DataFrame, y: str = "y168", k: int = 5) -> DataFrame:
    """Per collapse: the k best ranked names, starred where they followed, and all followers."""
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("score"), "cand"))
    name = F.concat("cand", F.when(F.col(y) == 1, "*").otherwise(""))
    rows = pairs.filter("seed_severity = 'collapse'").withColumn("_r", rank).filter((F.col("_r") <= k) | (F.col(y) == 1))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", name.alias("n"))))), lambda s: s["n"])
    return rows.groupBy("seed_id").agg(
        F.array_join(top, ", ").alias("top"), F.array_join(F.sort_array(F.collect_list(F.when(F.col(y) == 1, F.col("cand")))), ", ").alias("followers"))


def seed_changes(per_seed: DataFrame, a: str, b: str) -> DataFrame:
    """Per-seed change of average precision between two rankers: mean, seeds that move, mean without the largest gain."""
    left = per_seed.filter(F.col("model") == a).select("seed_id", F.col("ap").alias("_a"))
    right = per_seed.filter(F.col("model") == b).select("seed_id", F.col("ap").alias("_b"))
    d = left.join(right, "seed_id").withColumn("_d", F.col("_a") - F.col("_b"))
    return d.agg(
        F.count("*").alias("seeds"), F.avg("_d").alias("mean_change"), F.count(F.when(F.abs("_d") > 1e-12, 1)).alias("moved"),
        F.try_divide(F.sum("_d") - F.max("_d"), F.count("*") - 1).alias("mean_without_largest"))


def feature_follows(pairs: DataFrame, features: Sequence[str], y: str = "y168") -> DataFrame:
    """Pairs with a non-zero feature and how many of them followed."""
    doubles = pairs.select(y, *[F.col(c).cast("double").alias(c) for c in features])
    return doubles.unpivot([y], list(features), "feature", "value").filter("coalesce(value, 0) <> 0").groupBy("feature").agg(
        F.count("*").alias("pairs"), F.coalesce(F.sum(y), F.lit(0)).alias("followed"))


# ------------------------------------------------------------------------------------------------ score sources
def base_rate(train: DataFrame, rows: DataFrame, y: str, alpha: float = 500.0) -> DataFrame:
    """Smoothed share of positive hours per asset; an asset without training rows gets the overall share."""
    p = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    per = train.groupBy("symbol").agg(F.sum(y).alias("_k"), F.count(y).alias("_n"))
    return rows.join(per, "symbol", "left").withColumn("_p", p).withColumn(
        "score", F.coalesce((F.col("_k") + alpha * F.col("_p")) / (F.col("_n") + alpha), F.col("_p"))).drop("_k", "_n", "_p")


def drift(table: DataFrame, measures: Sequence[str], rows: int = 500, values: int = 100) -> DataFrame:
    """Per asset and measure: whether the test median leaves the training 5-95 % range, and the change of the median."""
    long = table.filter("has_exposure > 0").unpivot(["symbol", "split"], list(measures), "measure", "value")
    tr, te = F.col("split") == "train", F.col("split") == "test"
    v = F.col("value")
    some = lambda part: F.avg(F.when(part & v.isNotNull(), (v != 0).cast("double")))
    per = long.groupBy("symbol", "measure").agg(
        F.count(F.when(tr, 1)).alias("_ra"), F.count(F.when(te, 1)).alias("_rb"), F.count(F.when(tr, v)).alias("_a"), F.count(F.when(te, v)).alias("_b"),
        some(tr).alias("_za"), some(te).alias("_zb"))
    q = exact_quantiles(long.filter(tr | te), "value", {"lo": 0.05, "med": 0.5, "hi": 0.95}, ["symbol", "measure", "split"])
    a = q.filter(tr).select("symbol", "measure", "lo", "hi", F.col("med").alias("_ma"))
    b = q.filter(te).select("symbol", "measure", F.col("med").alias("_mb"))
    keep = (F.col("_ra") >= rows) & (F.col("_rb") >= rows) & (F.col("_a") >= values) & (F.col("_b") >= values) & ((F.col("_za") >= 0.5) | (F.col("_zb") >= 0.5))
    return per.filter(keep).join(a, ["symbol", "measure"]).join(b, ["symbol", "measure"]).select(
        "symbol", "measure", ((F.col("_mb") < F.col("lo")) | (F.col("_mb") > F.col("hi"))).alias("outside"), F.abs(F.col("_mb") - F.col("_ma")).alias("change"))


def flatten_results(main: DataFrame, robust: DataFrame, body: str = "body") -> DataFrame:
    """Nested result documents to (group, label, difference, low, high) rows, the robustness run beside the main one."""
    shape = "map<string, map<string, struct<diff: double, ci: array<double>>>>"

    def flat(df: DataFrame) -> DataFrame:
        one = df.select(F.explode(F.from_json(F.col(body), shape)).alias("group", "rows")).select("group", F.explode("rows").alias("label", "r"))
        return one.select("group", "label", F.col("r.diff").alias("difference"), F.element_at("r.ci", 1).alias("low"), F.element_at("r.ci", 2).alias("high"))

    other = flat(robust).select("group", "label", F.col("difference").alias("robust_difference"), F.col("low").alias("robust_low"), F.col("high").alias("robust_high"))
    return flat(main).join(other, ["group", "label"], "left")
