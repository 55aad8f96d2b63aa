"""Models as Spark ML jobs, their protocols, and the daily tail-risk model.

Only numbers with a bound set by the number of columns, folds or trees reach the driver: quantile bounds, medians,
coefficients, k by k matrices.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions.ranks import exact_quantiles, ranked, running_totals
from pegwatch.functions.scalars import clip, hash_uniform
from pegwatch.operators.metrics import average_precision
from pegwatch.operators.series import ffill, ordered
from pegwatch.rules import DAY
from pegwatch.session import cut, shared_folder


# ------------------------------------------------------------------------------------------------ preparation
def column_bounds(train: DataFrame, cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    """One row per column: exact train quantiles, median and the bounds to winsorise at. Bounds that coincide give way
    to the column's range, so a rare feature is not silenced."""
    doubles = train.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = doubles.unpivot([], list(cols), "measure", "value").filter("value is not null")
    q = exact_quantiles(long, "value", {"lo": lo, "med": 0.5, "hi": hi}, ["measure"])
    span = long.groupBy("measure").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    flat = ~(F.col("hi") > F.col("lo"))
    return q.join(span, "measure").select(
        "measure", F.when(flat, F.col("mn")).otherwise(F.col("lo")).alias("low"), F.when(flat, F.col("mx")).otherwise(F.col("hi")).alias("high"), "med")


def winsorise(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> list[DataFrame]:
    """Clips columns of several tables at the train bounds."""
    bounds = {r["measure"]: r for r in column_bounds(train, cols, lo, hi).collect()}
    done = {c: clip(F.col(c).cast("double"), bounds[c]["low"], bounds[c]["high"]) for c in cols if c in bounds}
    return [df.withColumns(done) for df in (train, *others)]


def prepare(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str], lo: float = 0.01, hi: float = 0.99,
            indicators: bool = False) -> tuple[list[DataFrame], list[str]]:
    """Winsorised and median-filled columns ``x_<c>`` (plus ``na_<c>`` where train has gaps) of every table."""
    bounds = {r["measure"]: r for r in column_bounds(train, cols, lo, hi).collect()}
    gaps = train.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    exprs, names = {}, []
    for c in cols:
        b = bounds.get(c)
        v = F.col(c).cast("double")
        exprs[f"x_{c}"] = F.coalesce(clip(v, b["low"], b["high"]), F.lit(b["med"])) if b else F.coalesce(v, F.lit(0.0))
        names.append(f"x_{c}")
        if indicators and gaps[c]:
            exprs[f"na_{c}"] = F.col(c).isNull().cast("double")
            names.append(f"na_{c}")
    return [df.withColumns(exprs) for df in (train, *others)], names


def drop_collinear(train: DataFrame, cols: Sequence[str], limit: float = 0.995) -> list[str]:
    """Columns that vary and are not almost collinear with an earlier kept one: each kept column strikes out the later
    ones that repeat it."""
    spread = train.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first().asDict()
    live = [c for c in cols if (spread[c] or 0.0) > 1e-9]
    vectors = VectorAssembler(inputCols=live, outputCol="_v", handleInvalid="skip").transform(train)
    repeats = np.triu(np.abs(Correlation.corr(vectors, "_v").first()[0].toArray()) >= limit, 1)
    open_ = np.ones(len(live), bool)
    for i, later in enumerate(repeats):
        if open_[i]:
            open_ &= ~later
    return [c for c, kept in zip(live, open_, strict=True) if kept]


def id_encoder(train: DataFrame, column: str, out: str = "id_vector") -> PipelineModel:
    """One place for each value of the training rows, in order, and one for values they lack: sparse vectors."""
    index = StringIndexer(inputCol=column, outputCol=f"_{out}_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_{out}_index"], outputCols=[out], dropLast=False, handleInvalid="error")
    return Pipeline(stages=[index, hot]).fit(train)


# ------------------------------------------------------------------------------------------------ learners
def logistic(train: DataFrame, cols: Sequence[str], y: str, C: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """L2 logistic regression on standardised columns. The penalty per row is 1 / (C n)."""
    n = train.count()
    assemble = VectorAssembler(inputCols=list(cols), outputCol="features")
    lr = LogisticRegression(labelCol=y, maxIter=200, tol=1e-8, regParam=1.0 / (C * n), standardization=True)
    model = lr.fit(assemble.transform(train.withColumn(y, F.col(y).cast("double"))).select("features", y))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(assemble.transform(df)).withColumn("score", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", "prediction")

    score.model = model
    return score


# Feature sets of the model ladder, as column-name predicates.
def feature_set(name: str, price: Sequence[str], exposure: Sequence[str]) -> list[str]:
    dynamic = [c for c in exposure if c.startswith("dlog_") or c.endswith("_to_collateral")]
    static = ("peg_eth", "cat_")
    plain = [c for c in price if not c.startswith(static)]
    return {
        "P": plain, "PE": [*plain, *exposure], "PEd": [*plain, *dynamic],
        "type": [c for c in price if c.startswith(static)] + list(exposure), "P_type": list(price),
    }[name]


def time_split(df: DataFrame, cols: Sequence[str], y: str, fit_on: Sequence[str] = ("train", "valid"), C: float = 1.0) -> DataFrame:
    """Fit on the earlier splits, score the rest; a single-class fit scores its mean."""
    earlier, later = df.filter(F.col("split").isin(*fit_on)), df.filter(~F.col("split").isin(*fit_on))
    return fit_or_mean(earlier, later, cols, y, C)


def fit_or_mean(train: DataFrame, test: DataFrame, cols: Sequence[str], y: str, C: float = 1.0) -> DataFrame:
    seen = train.agg(F.avg(F.col(y).cast("double")).alias("m")).first()["m"]
    if seen is None or seen in (0.0, 1.0):
        return test.withColumn("score", F.lit(seen))
    (tr, te), names = prepare(train, [test], cols)
    live = drop_collinear(tr, names, 1.1)
    return logistic(tr, live, y, C)(te).drop(*names)


def _by_fold(rows: DataFrame, group: str, fold: Callable[[DataFrame, str], DataFrame], threads: int = 4) -> DataFrame:
    """``fold(rows, value)`` of every value of the group, each written to a folder of its own and all read as one table:
    the plan that follows doesn't grow with the number of folds. Fits share the cluster."""
    spark = rows.sparkSession
    rows = cut(rows, "folds")
    folder = f"{shared_folder(spark)}/fold-results-{uuid.uuid4().hex}"
    values = sorted(r[0] for r in rows.select(group).distinct().collect())

    def run(k: int) -> None:
        fold(rows, values[k]).write.parquet(f"{folder}/fold={k}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(run, range(len(values))))
    return spark.read.parquet(folder).drop("fold")


def id_set(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str], ids: str) -> tuple[list[DataFrame], list[str]]:
    """Prepared numeric columns with the id vector beside them."""
    tables, names = prepare(train, others, cols)
    encoder = id_encoder(tables[0], ids)
    return [encoder.transform(t) for t in tables], [*names, "id_vector"]


def leave_one_out(df: DataFrame, group: str, cols: Sequence[str], y: str, threads: int = 4) -> DataFrame:
    """Scores every fold from a model of the other folds."""
    return _by_fold(df, group, lambda rows, v: fit_or_mean(rows.filter(F.col(group) != v), rows.filter(F.col(group) == v), cols, y), threads)


def permutation(score: Callable[[DataFrame], DataFrame], rows: DataFrame, cols: Sequence[str], y: str, key: Sequence[str],
                repeats: int = 3, seed: int = 0) -> DataFrame:
    """Drop in average precision when one column is shuffled, over all rows. A shuffle is a join of hash order with
    natural order, both found without a single-task sort."""
    numbered = ranked(rows.select(*key, y, *cols), [(k, False) for k in key])
    sample = cut(numbered.select(*key, y, *cols, F.col("rank").alias("_i")), "importance")
    base = average_precision(score(sample), (), y).first()["ap"]
    out = []
    for c in cols:
        drops = []
        for r in range(repeats):
            mixed = ranked(sample.select(c, "_i", hash_uniform(F.lit(seed + r + 1), F.lit(c), "_i").alias("_h")), [("_h", False), ("_i", False)])
            shuffled = sample.drop(c).join(mixed.select(F.col("rank").alias("_i"), c), "_i")
            drops.append(base - average_precision(score(shuffled), (), y).first()["ap"])
        out.append((c, float(np.mean(drops)), float(np.std(drops))))
    return rows.sparkSession.createDataFrame(out, "feature string, ap_drop double, std double")


# ------------------------------------------------------------------------------------------------ inference
def chi2_tail(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 1.0
    term = total = 1.0 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


INFERENCE = ("feature string, beta double, se double, odds_ratio double, or_low double, or_high double, p double, separation boolean, "
             "wald double, wald_p double, clusters int")


def robust_cov(rows: DataFrame, cols: Sequence[str], y: str, cluster: str, block: Sequence[str] = (), ridge: float = 1e-4,
               least: int = 5) -> DataFrame:
    """Coefficients of a logistic model per standard deviation with cluster-robust errors and a Wald test of a block.
    Constant columns are left out; with too few rows of either outcome there is no result.

    Spark sums the information matrix and the outer product of the cluster scores (k squared sums each); only these two
    matrices come to the driver.
    """
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols], F.count("*").alias("n"),
                     F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("pos")).first()
    cols = [c for c in cols if stats[f"s_{c}"] is not None and stats[f"s_{c}"] > 1e-9]
    block = [c for c in block if c in cols]
    n, k = stats["n"], len(cols)
    if k == 0 or stats["pos"] < least or n - stats["pos"] < least:
        return rows.sparkSession.createDataFrame([], INFERENCE)
    std = rows.select(cluster, F.col(y).cast("double").alias("_y"), *[((F.col(c).cast("double") - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(f"b_{c}") for c in cols])
    names = [f"b_{c}" for c in cols]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    fitted: LogisticRegressionModel = LogisticRegression(labelCol="_y", maxIter=500, tol=1e-10, regParam=ridge / n, standardization=False).fit(
        assemble.transform(std).select("features", "_y"))
    beta = np.r_[fitted.intercept, fitted.coefficients.toArray()]
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    margin = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], names, strict=True):
        margin = margin + float(b) * F.col(c)
    p = 1.0 / (1.0 + F.exp(-clip(margin, -35.0, 35.0)))
    scored = std.withColumn("_p", p)
    w = F.col("_p") * (1 - F.col("_p"))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    info = scored.agg(*[F.sum(x[i] * x[j] * w).alias(f"h_{i}_{j}") for i, j in pairs]).first()
    per = scored.groupBy(cluster).agg(*[F.sum(x[i] * (F.col("_y") - F.col("_p"))).alias(f"u_{i}") for i in range(k + 1)])
    meat = per.agg(F.count("*").alias("g"), *[F.sum(F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    H, Mt = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
    for i, j in pairs:
        H[i, j] = H[j, i] = info[f"h_{i}_{j}"]
        Mt[i, j] = Mt[j, i] = meat[f"c_{i}_{j}"]
    inv = np.linalg.inv(H + np.diag(np.r_[0.0, np.full(k, ridge)]))
    g = meat["g"]
    V = inv @ Mt @ inv * (g / max(g - 1, 1)) * ((n - 1) / max(n - k - 1, 1))
    se = np.sqrt(np.maximum(np.diag(V), 0.0))
    tested = np.flatnonzero([c in block for c in cols]) + 1
    wald = float(beta[tested] @ np.linalg.pinv(V[np.ix_(tested, tested)]) @ beta[tested]) if len(tested) else None
    tails = [math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else 1.0 for b, s in zip(beta, se, strict=True)]
    each = rows.sparkSession.createDataFrame(
        [(c, float(b), float(s), float(t)) for c, b, s, t in zip(cols, beta[1:], se[1:], tails[1:], strict=True)], "feature string, beta double, se double, p double")
    odds = [F.exp(clip(F.col("beta") + k * F.col("se"), -50.0, 50.0)).alias(name) for name, k in (("odds_ratio", 0.0), ("or_low", -1.96), ("or_high", 1.96))]
    return each.select(
        "feature", "beta", "se", *odds, "p", (F.abs("beta") > 5).alias("separation"), F.lit(wald).cast("double").alias("wald"),
        F.lit(None if wald is None else chi2_tail(wald, len(tested))).cast("double").alias("wald_p"), F.lit(int(g)).alias("clusters"))


def drop_one(rows: DataFrame, cols: Sequence[str], y: str, group: str, block: Sequence[str] = ()) -> DataFrame:
    """The inference once without each group: range of the odds ratios."""
    out = _by_fold(rows, group, lambda every, v: robust_cov(every.filter(F.col(group) != v), cols, y, group, block))
    return out.groupBy("feature").agg(F.min("odds_ratio").alias("or_min"), F.max("odds_ratio").alias("or_max"), F.max("p").alias("p_max"), F.count("*").alias("fits"))


# ------------------------------------------------------------------------------------------------ daily tail risk
def ar1(z: DataFrame, pegs: DataFrame, train_end: int, least: int = 90) -> DataFrame:
    """First-order autoregression of daily closes per asset, pooled by peg where an asset has few training days.
    Adds the forecast ``mu`` of the next close and the residual of today's."""
    rows = ffill(z.select("symbol", "ts", "z"), "z", 3, ["symbol"]).join(pegs.select("symbol", "peg"), "symbol")
    lagged = rows.withColumn("_x", F.lag("z").over(ordered(["symbol"])))
    fit = lagged.filter((F.col("ts") <= train_end) & F.col("_x").isNotNull() & F.col("z").isNotNull())
    slope, start, n = F.regr_slope("z", "_x"), F.regr_intercept("z", "_x"), F.count("*")
    own = fit.groupBy("symbol").agg(n.alias("_n"), start.alias("_a"), slope.alias("_b"))
    pooled = fit.groupBy("peg").agg(start.alias("_pa"), slope.alias("_pb"))
    use = F.coalesce(F.col("_n") >= least, F.lit(False))
    b = lambda c: F.greatest(F.least(F.col(c), F.lit(0.999)), F.lit(0.0))
    out = lagged.join(own, "symbol", "left").join(pooled, "peg", "left").withColumn(
        "a", F.when(use, F.col("_a")).otherwise(F.col("_pa"))).withColumn("b", F.when(use, b("_b")).otherwise(b("_pb")))
    mu = F.when(F.col("z").isNotNull(), F.col("a") + F.col("b") * F.col("z"))
    return out.withColumn("mu", mu).withColumn("own", use).withColumn("resid", F.col("z") - F.lag("mu").over(ordered(["symbol"]))).select(
        "symbol", "ts", "z", "own", "a", "b", "mu", "resid")


def ewma(resid: DataFrame, train_end: int, lam: float = 0.94) -> DataFrame:
    """Exponentially weighted variance of the residuals; a day without one holds the value.

    Written out, the recursion weighs a known day by lambda to the number of known days since. Days whose weight is
    beyond double precision add nothing, so the sum looks back over a fixed number of known days, however long the series.
    """
    sq = F.col("resid") * F.col("resid")
    train = resid.filter((F.col("ts") <= train_end) & F.col("resid").isNotNull()).withColumn("_sq", sq)
    init = exact_quantiles(train, "_sq", {"m": 0.5}).select("m").scalar()
    reach = math.ceil(math.log(1e-18) / math.log(lam))
    rows = resid.withColumn("_k", F.count("resid").over(ordered(["symbol"]).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_init", init)
    near = Window.partitionBy("symbol").orderBy("_k").rangeBetween(-reach, 0)
    seen = F.collect_list(F.when(F.col("resid").isNotNull(), F.struct(F.col("_k").alias("k"), sq.alias("sq")))).over(near)
    rows = rows.withColumn("_seen", seen)
    weight = lambda days: F.pow(F.lit(lam), days.cast("double"))
    total = F.aggregate("_seen", F.lit(0.0), lambda acc, x: acc + x["sq"] * weight(F.col("_k") - x["k"]))
    return rows.withColumn("variance", weight(F.col("_k")) * F.col("_init") + (1 - lam) * total).drop("_k", "_init", "_seen")


def tail_fit(rows: DataFrame, train_end: int, tail: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Standardised training residuals and one row with the tail cut and the generalised Pareto shape and scale, by
    probability-weighted moments (Hosking and Wallis 1987)."""
    sd = F.sqrt(F.lag("variance").over(ordered(["symbol"])))
    u = rows.withColumn("u", F.try_divide("resid", sd)).filter((F.col("ts") <= train_end) & F.col("u").isNotNull()).select("symbol", "ts", "u")
    u = cut(u, "tail_u")
    q = exact_quantiles(u, "u", {"q": tail})
    exc = u.withColumn("_q", q.select("q").scalar()).filter("u < _q").select("symbol", "ts", (F.col("_q") - F.col("u")).alias("x"))
    order = ranked(exc, [("x", False), ("symbol", False), ("ts", False)])
    weight = 1 - (F.col("rank") - 0.35) / F.col("total")
    mom = order.agg(F.avg("x").alias("a0"), F.avg(F.col("x") * weight).alias("a1"))
    gap = F.col("a0") - 2 * F.col("a1")
    fit = mom.select(F.try_divide(F.col("a0"), gap).alias("_r"), F.try_divide(2 * F.col("a0") * F.col("a1"), gap).alias("scale")).select(
        (F.col("_r") - 2).alias("shape"), "scale").withColumn("q", q.select("q").scalar())
    return u, fit


def tail_probability(rows: DataFrame, train_end: int, tail: float = 0.10) -> DataFrame:
    """Chance that the next close lies at or beyond the threshold: empirical body, Pareto tail below the cut."""
    rows = cut(rows, "tail_rows")
    u, fit = tail_fit(rows, train_end, tail)
    v = rows.filter("mu is not null").withColumn("v", F.try_divide(-1.0 - F.col("mu"), F.sqrt("variance")))
    marks = u.select(F.col("u").alias("x"), F.lit(1.0).alias("_u")).unionByName(v.filter("v is not null").select(F.col("v").alias("x"), F.lit(0.0).alias("_u")))
    run = running_totals(marks.groupBy("x").agg(F.sum("_u").alias("_n")), "x", ["_n"])
    body = run.select(F.col("x").alias("v"), F.try_divide("cum__n", "all__n").alias("_body"))
    out = v.join(body, "v", "left").withColumn("_f", fit.select(F.struct("*")).scalar())
    x, k, a = F.col("_f.q") - F.col("v"), F.col("_f.shape"), F.col("_f.scale")
    inner = 1 - k * x / a
    sf = F.when(F.abs(k) < 1e-9, F.exp(-x / a)).when(inner > 0, F.pow(inner, 1 / k)).otherwise(0.0)
    return out.withColumn("p_next", F.when(F.col("v") < F.col("_f.q"), tail * sf).otherwise(F.col("_body"))).select(
        "symbol", "ts", "z", "mu", "variance", "v", "p_next")


def daily_rows(z: DataFrame) -> DataFrame:
    return z.filter(F.col("ts") % DAY == 0)
