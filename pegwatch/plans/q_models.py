"""Queries on models, inference, the daily tail model and streams."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pegwatch.operators import features as X
from pegwatch.operators import models as L
from pegwatch.operators import trees as TR
from pegwatch.plans import standins as T
from pegwatch.plans.q_features import rounded
from pegwatch.plans.q_graph import links
from pegwatch.plans.q_metrics import scored_pairs
from pegwatch.plans.registry import block, query
from pegwatch.session import shared_folder, staged
from pegwatch.streaming import live

P = ["z_now", "z_min_24h", "z_mean_24h", "z_std_24h", "near_frac_24h", "hours_since_near_miss", "mkt_stress_frac", "episodes_30d"]
E = ["log_family_collateral_usd", "borrow_to_collateral"]


@query("b21_winsor_bounds", "SELECT measure, round(CASE WHEN hi > lo THEN lo ELSE mn END, 6) AS low, round(CASE WHEN hi > lo THEN hi ELSE mx END, 6) AS high, round(med, 6) AS med FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, min({c}) AS mn, max({c}) AS mx FROM onset WHERE split = 'train'" for c in [*P, *E]) + ")", ["onset"])
def b21(spark, sf):
    out = L.column_bounds(T.onset(spark, sf).filter("split = 'train'"), [*P, *E], 0.01, 0.99)
    return rounded(out, ["measure", "low", "high", "med"])


@query("b22_median_fill", """
SELECT symbol, ts, round(coalesce(greatest(least(z_std_24h, hi), lo), med), 6) AS x_z_std_24h, CAST(z_std_24h IS NULL AS DOUBLE) AS na_z_std_24h
FROM onset, (SELECT quantile_cont(z_std_24h, 0.01) AS lo, quantile_cont(z_std_24h, 0.99) AS hi, quantile_cont(z_std_24h, 0.5) AS med FROM onset WHERE split = 'train')
WHERE split = 'test'""".replace("coalesce(greatest(least(z_std_24h, hi), lo), med)", "CASE WHEN z_std_24h IS NULL THEN med ELSE greatest(least(z_std_24h, hi), lo) END"), ["onset"])
def b22(spark, sf):
    d = T.onset(spark, sf)
    (_, te), _ = L.prepare(d.filter("split = 'train'"), [d.filter("split = 'test'")], ["z_std_24h"], indicators=True)
    return rounded(te, ["symbol", "ts", "x_z_std_24h", "na_z_std_24h"])


def sieve_sql(cols: dict[str, str], source: str, limit: float = 0.995) -> str:
    """Keeps a varying column unless an earlier kept one is almost collinear with it: one flag after another."""
    names = list(cols)
    moments = ", ".join([f"coalesce(stddev_samp({c}), 0) AS s_{c}" for c in names] + [f"coalesce(abs(corr({a}, {b})), 0) AS c_{a}_{b}" for i, b in enumerate(names) for a in names[:i]])
    flags = ", ".join(f"s_{b} > 1e-9" + "".join(f" AND NOT (k_{a} AND c_{a}_{b} >= {limit})" for a in names[:i]) + f" AS k_{b}" for i, b in enumerate(names))
    shown = ", ".join(f"CASE WHEN k_{c} THEN '{c}' END" for c in names)
    return f"""SELECT feature FROM (SELECT unnest([{shown}]) AS feature FROM (SELECT {flags} FROM (SELECT {moments} FROM (
  SELECT {', '.join(f'{x} AS {c}' for c, x in cols.items())} FROM {source})))) WHERE feature IS NOT NULL"""


@query("b23_drop_collinear", sieve_sql({**{c: f"coalesce(CAST({c} AS DOUBLE), 0)" for c in P}, "copy": "coalesce(z_now, 0) * 2", "constant": "1.0"}, "onset WHERE split = 'train'"), ["onset"])
def b23(spark, sf):
    d = T.onset(spark, sf).filter("split = 'train'").fillna(0.0).withColumn("copy", F.col("z_now") * 2).withColumn("constant", F.lit(1.0))
    kept = L.drop_collinear(d, [*P, "copy", "constant"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("i2_logistic")
def i2(spark, sf):
    d = T.onset(spark, sf).filter("y24 is not null")
    (tr, te), names = L.prepare(d.filter("split = 'train'"), [d.filter("split = 'test'")], P, 0.001, 0.999, indicators=True)
    return rounded(L.logistic(tr, names, "y24")(te), ["symbol", "ts", "y24", "score"])


@query("i3_trees")
def i3(spark, sf):
    """Two leaf sizes and seeds over 20 rounds; the operator's defaults are four, five and 300."""
    d = T.onset(spark, sf).filter("y24 is not null")
    (tr, va, te), names = L.prepare(d.filter("split = 'train'"), [d.filter("split = 'valid'"), d.filter("split = 'test'")], P)
    score = TR.boosted(tr, va, names, "y24", seeds=(0, 1), leaves=(20, 50), rounds=20, every=10, depth=3)
    return rounded(score(te, ["symbol", "ts", "y24"]), ["symbol", "ts", "y24", "score"])


@query("b10_id_one_hots", """
SELECT o.symbol, ts, coalesce(k, (SELECT count(DISTINCT symbol) FROM onset WHERE split = 'train')) AS slot, CAST(1 AS DOUBLE) AS value
FROM onset o LEFT JOIN (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM onset WHERE split = 'train')) s ON s.symbol = o.symbol""", ["onset"])
def b10i(spark, sf):
    """The non-zero entries of the id vectors; assets that training lacks share the last place."""
    d = T.onset(spark, sf)
    hot = vector_to_array(F.col("id_vector"))
    rows = L.id_encoder(d.filter("split = 'train'"), "symbol").transform(d).select("symbol", "ts", F.posexplode(hot).alias("slot", "value")).filter("value <> 0")
    return rows.withColumn("slot", F.col("slot").cast("bigint"))


@query("i2_i4_fit_equations", """
SELECT model, count(*) AS rows_fit, CAST(sum(y24) AS BIGINT) AS positives, CAST(sum(y24) AS BIGINT) AS expected
FROM onset, (SELECT unnest(['P', 'PE', 'P_id']) AS model) WHERE split = 'train' AND y24 IS NOT NULL GROUP BY model""", ["onset"])
def i24(spark, sf):
    """A logistic model with a free intercept expects as many positives as it was trained on."""
    tr = T.onset(spark, sf).filter("y24 is not null and split = 'train'")
    out = None
    for name in ("P", "PE", "P_id"):
        (t,), cols = L.id_set(tr, [], P, "symbol") if name == "P_id" else L.prepare(tr, [], L.feature_set(name, P, E))
        one = L.logistic(t, cols, "y24")(t).agg(F.lit(name).alias("model"), F.count("*").alias("rows_fit"), F.sum(F.col("y24").cast("bigint")).alias("positives"), F.round(F.sum("score")).cast("bigint").alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


@query("i4_i6_feature_sets")
def i4(spark, sf):
    d = T.onset(spark, sf).filter("y24 is not null")
    out = None
    for name in ("P", "PE"):
        one = L.time_split(d, L.feature_set(name, P, E), "y24").select("symbol", "ts", "y24", "score").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["model", "symbol", "ts", "y24", "score"])


CORE = ["depth_frac", "ep_z_first", "ep_hours_below", "pre_z_min_24h", "log_prior_episodes", "prior_severe_share"]


@query("i5_heuristics", """
SELECT episode_id, landmark, round(coalesce(depth_frac, 0), 6) AS depth, round(prior_severe_share, 6) AS asset_hist, round((SELECT avg(y_severe) FROM escalation WHERE landmark = 1), 6) AS prior
FROM escalation WHERE landmark = 1""", ["escalation"])
def i5(spark, sf):
    rows = T.escalation(spark, sf).filter("landmark = 1")
    return rows.withColumn("prior", rows.agg(F.avg(F.col("y_severe").cast("double"))).scalar()).select(
        "episode_id", "landmark", F.round(F.coalesce("depth_frac", F.lit(0.0)), 6).alias("depth"), F.round("prior_severe_share", 6).alias("asset_hist"), F.round("prior", 6).alias("prior"))


@query("i7_leave_one_out")
def i7(spark, sf):
    rows = T.escalation(spark, sf).filter("landmark = 1 and y_severe is not null").withColumn("category", F.element_at(F.split("symbol", "_"), 1))
    return rounded(L.leave_one_out(rows, "category", CORE, "y_severe"), ["episode_id", "category", "y_severe", "score"])


@query("i10_permutation")
def i10(spark, sf):
    d = T.onset(spark, sf).filter("y24 is not null")
    (tr, va), names = L.prepare(d.filter("split = 'train'"), [d.filter("split = 'valid'")], P)
    score = L.logistic(tr, names, "y24")
    return rounded(L.permutation(score, va, names, "y24", ["symbol", "ts"], repeats=3), ["feature", "ap_drop", "std"])


@query("i11_robust_errors")
def i11(spark, sf):
    rows = scored_pairs(spark, sf).join(links(spark, sf).select("seed_id", F.col("cand_asset").alias("cand"), "same_family", "log_pool_overlap"), ["seed_id", "cand"])
    return rounded(L.robust_cov(rows, ["follow_rate", "codepeg_share", "same_family", "log_pool_overlap"], "y168", "seed", ["log_pool_overlap"]),
                   ["feature", "beta", "se", "odds_ratio", "or_low", "or_high", "p", "separation", "wald", "wald_p", "clusters"])


@query("j19_drop_one_group")
def j19(spark, sf):
    rows = T.escalation(spark, sf).filter("landmark = 1 and y_severe is not null").withColumn("category", F.element_at(F.split("symbol", "_"), 1))
    out = L.drop_one(rows, ["prior_severe_share", "ep_hours_below"], "y_severe", "category", ["ep_hours_below"])
    return rounded(out, ["feature", "or_min", "or_max", "p_max", "fits"])


# ------------------------------------------------------------------------------------------------ daily tail model
LEAST = 11
block("ar", f"""
SELECT symbol, ts, z, coalesce(n >= {LEAST}, false) AS own, CASE WHEN n >= {LEAST} THEN a ELSE pa END AS a, greatest(least(CASE WHEN n >= {LEAST} THEN b ELSE pb END, 0.999), 0) AS b
FROM (
  SELECT f.*, peg, o.n, o.a, o.b, p.a AS pa, p.b AS pb FROM zfill f JOIN registry USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS n, regr_intercept(z, x) AS a, regr_slope(z, x) AS b FROM zfill WHERE ts <= 1705276800 AND x IS NOT NULL AND z IS NOT NULL GROUP BY symbol) o USING (symbol)
  LEFT JOIN (SELECT peg, regr_intercept(z, x) AS a, regr_slope(z, x) AS b FROM zfill JOIN registry USING (symbol) WHERE ts <= 1705276800 AND x IS NOT NULL AND z IS NOT NULL GROUP BY peg) p USING (peg))""", ["zfill", "registry"])
block("zfill", """
SELECT *, lag(z) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM (
  SELECT symbol, ts, last_value(z IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS z FROM zday)""", ["zday"])
block("arr", "SELECT *, a + b * z AS mu, z - lag(a + b * z) OVER (PARTITION BY symbol ORDER BY ts) AS resid FROM ar", ["ar"])


def daily_ar(spark, sf):
    return L.ar1(X.daily_closes(T.dev(spark, sf)), T.registry(spark, sf), T.RULES.train_end, LEAST)


@query("i8_ar1", "SELECT symbol, ts, own, round(a, 6) AS a, round(b, 6) AS b, round(mu, 6) AS mu, round(resid, 6) AS resid FROM arr", ["arr"])
def i8(spark, sf):
    return rounded(daily_ar(spark, sf), ["symbol", "ts", "own", "a", "b", "mu", "resid"])


block("ew", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM arr),
i0 AS (SELECT quantile_cont(resid * resid, 0.5) AS v FROM arr WHERE ts <= 1705276800 AND resid IS NOT NULL),
r AS (SELECT symbol, ts, i, mu, resid, CASE WHEN resid IS NULL THEN v ELSE 0.94 * v + 0.06 * resid * resid END AS variance FROM o, i0 WHERE i = 1
  UNION ALL SELECT o.symbol, o.ts, o.i, o.mu, o.resid, CASE WHEN o.resid IS NULL THEN r.variance ELSE 0.94 * r.variance + 0.06 * o.resid * o.resid END FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT * FROM r""".replace("WITH o", "WITH RECURSIVE o"), ["arr"])


@query("e25_ewma_variance", "SELECT symbol, ts, round(variance, 6) AS variance FROM ew", ["ew"])
def e25(spark, sf):
    return rounded(L.ewma(daily_ar(spark, sf), T.RULES.train_end), ["symbol", "ts", "variance"])


block("us", "SELECT * FROM (SELECT symbol, ts, resid / sqrt(lag(variance) OVER (PARTITION BY symbol ORDER BY ts)) AS u FROM ew) WHERE ts <= 1705276800 AND u IS NOT NULL", ["ew"])
block("gpd", """
SELECT q, a0 / (a0 - 2 * a1) - 2 AS k, 2 * a0 * a1 / (a0 - 2 * a1) AS s FROM (
  SELECT any_value(q) AS q, avg(x) AS a0, avg(x * (1 - (r - 0.35) / n)) AS a1 FROM (
    SELECT q, q - u AS x, row_number() OVER (ORDER BY q - u, symbol, ts) AS r, count(*) OVER () AS n FROM us, (SELECT quantile_cont(u, 0.1) AS q FROM us) WHERE u < q))""", ["us"])


@query("i9_tail_probability", """
SELECT symbol, ts, round(v, 6) AS v, round(CASE WHEN v < q THEN 0.1 * CASE WHEN 1 - k * (q - v) / s > 0 THEN pow(1 - k * (q - v) / s, 1 / k) ELSE 0 END
  ELSE (SELECT count(*) FROM us WHERE u <= v) / (SELECT count(*) FROM us) END, 6) AS p_next
FROM (SELECT symbol, ts, (-1 - mu) / sqrt(variance) AS v FROM ew WHERE mu IS NOT NULL), gpd""", ["ew", "us", "gpd"])
def i9(spark, sf):
    rows = L.ewma(daily_ar(spark, sf), T.RULES.train_end)
    return rounded(L.tail_probability(rows, T.RULES.train_end), ["symbol", "ts", "v", "p_next"])


# ------------------------------------------------------------------------------------------------ streams
def streamed(spark, df, name, build, slices=3):
    """A table of the batch side arriving in time slices: each is written, then the stream goes on from where it stopped. Returns the
    table that ``build`` of the stream wrote."""
    path, base, out = f"{shared_folder(spark)}/slices/{name}-{uuid.uuid4().hex}", live.new_base(spark, name), None
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    for i in range(slices):
        lo, hi = first + (last - first) * i // slices, first + (last - first) * (i + 1) // slices
        df.filter((F.col("ts") >= lo) & ((F.col("ts") < hi) | F.lit(i == slices - 1))).write.mode("append").parquet(path)
        rows = spark.readStream.schema(df.schema).parquet(path).withColumn("time", F.timestamp_seconds("ts"))
        out = live.run_to_table(build(rows), name, base)
    return out


@query("l1_stream_hourly", """
SELECT symbol, ts // 3600 * 3600 AS ts, round(quantile_cont(price, 0.5), 6) AS price, count(*) AS n FROM samples
WHERE ts // 3600 * 3600 + 3600 <= (SELECT max(ts) FROM samples) - 7200 GROUP BY symbol, ts // 3600""", ["samples"])
def l1(spark, sf):
    return rounded(streamed(spark, T.samples(spark, sf).select("symbol", "ts", "price"), "hourly", live.hourly), ["symbol", "ts", "price", "n"])


@staged
def monitored(spark, sf):
    known = T.dev(spark, sf).filter("dev_obs is not null").select("symbol", "ts", "dev_obs", "theta")
    return streamed(spark, known, "monitor", lambda rows: live.monitor(rows, T.RULES))


@query("l2_stream_monitor", """
SELECT symbol, t0, t1, confirmed_at, hours_below, round(min_dev, 5) AS min_dev FROM detected WHERE NOT ongoing""", ["detected"])
def l2(spark, sf):
    return rounded(monitored.build(spark, sf).filter("kind = 'close'"), ["symbol", "t0", "t1", "confirmed_at", "hours_below", "min_dev"], 5)


@query("l2_stream_open", """
SELECT symbol, t0, t1, confirmed_at, hours_below, round(min_dev, 5) AS min_dev FROM detected WHERE ongoing""", ["detected"])
def l2o(spark, sf):
    """Episodes that the end of the stream leaves open."""
    return rounded(live.open_episodes(monitored(spark, sf)), ["symbol", "t0", "t1", "confirmed_at", "hours_below", "min_dev"], 5)


@query("l3_stream_sessions", """
WITH b AS (SELECT symbol, ts FROM dev WHERE dev_obs <= -0.40007), g AS (
  SELECT symbol, ts - 3600 * row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, ts FROM b)
SELECT symbol, min(ts) AS start, count(*) AS hours, 1 AS y FROM g GROUP BY symbol, k HAVING max(ts) + 3600 <= (SELECT max(ts) FROM b) - 7200""", ["dev"])
def l3(spark, sf):
    rows = T.dev(spark, sf).filter("dev_obs <= -0.40007").select("symbol", "ts", F.lit(1).alias("y"))
    return streamed(spark, rows, "sessions", live.sessions).select("symbol", "start", "hours", "y")
