"""Queries on ranking metrics, alerts, events, bootstraps and placebo rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.operators import metrics as M
from pegwatch.operators import resample as R
from pegwatch.operators import tables as B
from pegwatch.plans import standins as T
from pegwatch.plans.q_features import rounded
from pegwatch.plans.q_graph import links
from pegwatch.plans.registry import block, query
from pegwatch.session import staged

UNIFORM = "(CAST('0x' || substr(md5(concat_ws('|', {0})), 1, 12) AS BIGINT) / 281474976710656)"
DRAWS = 1000


@staged
def preds(spark, sf):
    """Scores of three simple rankers: the deviation rule, the mean level and the smoothed base rate."""
    rows = T.onset(spark, sf).filter("y24 is not null").select(
        "symbol", "ts", F.col("y24").alias("y"), "has_exposure", "split",
        F.coalesce(-F.col("z_min_6h"), F.lit(0.0)).alias("rule"), F.coalesce(-F.round("z_mean_24h", 6), F.lit(0.0)).alias("level"))
    rated = M.base_rate(rows.filter("split = 'train'"), rows, "y")
    score = F.explode(F.create_map(F.lit("rule"), F.round("rule", 9), F.lit("level"), F.col("level"), F.lit("base"), F.round("score", 9)))
    return rated.select("symbol", "ts", "y", "has_exposure", "split", score.alias("model", "score"))


block("scored", """
SELECT symbol, ts, y24 AS y, has_exposure, split, round(coalesce(-z_min_6h, 0), 9) AS rule, coalesce(-round(z_mean_24h, 6), 0) AS level FROM onset WHERE y24 IS NOT NULL""", ["onset"])
block("preds", """
SELECT symbol, ts, y, has_exposure, split, model, score FROM (
  SELECT s.symbol, ts, y, has_exposure, split, rule, level,
    round(coalesce((k + 500 * p) / (n + 500), p), 9) AS base
  FROM scored s LEFT JOIN (SELECT symbol, sum(y) AS k, count(y) AS n FROM scored WHERE split = 'train' GROUP BY symbol) USING (symbol),
       (SELECT avg(y) AS p FROM scored WHERE split = 'train')
) UNPIVOT (score FOR model IN (rule, level, base))""", ["scored"])


def test_rows(spark, sf):
    return preds(spark, sf).filter("split = 'test'")


block("test", "SELECT * FROM preds WHERE split = 'test'", ["preds"])


@query("i1_rule_scores", "SELECT symbol, ts, y, split, model, round(score, 6) AS score FROM preds", ["preds"])
def i1(spark, sf):
    return rounded(preds.build(spark, sf), ["symbol", "ts", "y", "split", "model", "score"])


@query("d18_base_rate", "SELECT symbol, count(*) AS rows, round(avg(score), 6) AS score FROM preds WHERE model = 'base' GROUP BY symbol", ["preds"])
def d18(spark, sf):
    return preds(spark, sf).filter("model = 'base'").groupBy("symbol").agg(F.count("*").alias("rows"), F.round(F.avg("score"), 6).alias("score"))


def ap_sql(source, by, w="1"):
    return f"""
SELECT {by}, sum(tp * ctp / cn) / nullif(max(p), 0) AS ap, max(n) AS rows, max(p) AS positives FROM (
  SELECT {by}, tp, sum(tp) OVER o AS ctp, sum(c) OVER o AS cn, sum(tp) OVER (PARTITION BY {by}) AS p, sum(c) OVER (PARTITION BY {by}) AS n
  FROM (SELECT {by}, score, sum({w}) AS c, sum({w} * y) AS tp FROM {source} GROUP BY {by}, score HAVING sum({w}) > 0)
  WINDOW o AS (PARTITION BY {by} ORDER BY score DESC)) GROUP BY {by}"""


block("ap", ap_sql("preds", "model, split"), ["preds"])


@query("j1_average_precision", "SELECT model, split, round(ap, 6) AS ap, CAST(rows AS BIGINT) AS rows, CAST(positives AS BIGINT) AS positives FROM ap", ["ap"])
def j1(spark, sf):
    out = M.average_precision(preds(spark, sf), ["model", "split"])
    return out.select("model", "split", F.round("ap", 6).alias("ap"), F.col("rows").cast("bigint").alias("rows"), F.col("positives").cast("bigint").alias("positives"))


@query("j1_weighted_ap", "SELECT model, round(ap, 6) AS ap FROM (" + ap_sql("(SELECT *, 1 + CAST(split_part(symbol, '_', 2) AS INT) AS w FROM preds)", "model", "w") + ")", ["preds"])
def j1w(spark, sf):
    rows = preds(spark, sf).withColumn("w", 1.0 + F.element_at(F.split("symbol", "_"), 2).cast("int"))
    return rounded(M.average_precision(rows, ["model"], weight="w"), ["model", "ap"])


@query("j2_auc", """
SELECT a.model, a.split, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.n * b.n) / nullif(sum(a.n * b.n), 0), 6) AS auc
FROM (SELECT model, split, score, count(*) AS n FROM preds WHERE y = 1 GROUP BY ALL) a
JOIN (SELECT model, split, score, count(*) AS n FROM preds WHERE y = 0 GROUP BY ALL) b ON a.model = b.model AND a.split = b.split GROUP BY a.model, a.split""", ["preds"])
def j2(spark, sf):
    return rounded(M.auc(preds(spark, sf), ["model", "split"]), ["model", "split", "auc"])


@query("j3_brier", "SELECT model, split, round(avg((score - y) * (score - y)), 6) AS brier FROM preds GROUP BY model, split", ["preds"])
def j3(spark, sf):
    return rounded(M.brier(preds(spark, sf), ["model", "split"]), ["model", "split", "brier"])


@query("j4_asset_ap", "SELECT model, round(avg(ap), 6) AS asset_ap, count(*) AS assets FROM (" + ap_sql("preds", "model, symbol") + ") WHERE positives > 0 AND positives < rows GROUP BY model", ["preds"])
def j4(spark, sf):
    return rounded(M.asset_ap(preds(spark, sf), ["model"]), ["model", "asset_ap", "assets"])


@query("j4_exposed_ap", "SELECT model, part, round(CASE WHEN positives >= 10 AND positives < rows THEN ap END, 6) AS ap, CAST(positives AS BIGINT) AS positives FROM ("
       + ap_sql("(SELECT *, CASE WHEN has_exposure > 0 THEN 'exposed' ELSE 'unexposed' END AS part FROM preds)", "model, part") + ")", ["preds"])
def j4e(spark, sf):
    out = M.exposed_ap(preds(spark, sf), ["model"])
    return out.select("model", "part", F.round("ap", 6).alias("ap"), F.col("positives").cast("bigint").alias("positives"))


block("alerts", """
SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, ts, symbol) <= round_even(0.05 * count(*) OVER (PARTITION BY model), 0) AS alert FROM test""", ["test"])


@staged
def alerts(spark, sf):
    return M.top_alerts(test_rows(spark, sf), ["model"])


@query("f1_top_share", "SELECT model, symbol, ts, alert FROM alerts", ["alerts"])
def f1(spark, sf):
    return alerts.build(spark, sf).select("model", "symbol", "ts", "alert")


@query("f1_top_share_all", """
SELECT symbol, ts, row_number() OVER (ORDER BY score DESC, ts, symbol) <= round_even(0.05 * count(*) OVER (), 0) AS alert FROM preds WHERE model = 'base'""", ["preds"])
def f1a(spark, sf):
    return M.top_alerts(preds(spark, sf).filter("model = 'base'")).select("symbol", "ts", "alert")


block("thr", "SELECT model, quantile_cont(score, 0.99) AS thr_0, quantile_cont(score, 0.95) AS thr_1 FROM preds WHERE split = 'valid' GROUP BY model", ["preds"])


def budgets(spark, sf):
    return M.thresholds(preds(spark, sf).filter("split = 'valid'"), ["model"], [0.01, 0.05])


@query("f2_threshold_budgets", """
SELECT model, round(thr_0, 6) AS thr_0, round(thr_1, 6) AS thr_1, count(*) FILTER (score >= thr_0) AS alerts_1, count(*) FILTER (score >= thr_1) AS alerts_5 FROM test JOIN thr USING (model) GROUP BY ALL""", ["test", "thr"])
def f2(spark, sf):
    rows = test_rows(spark, sf).join(budgets(spark, sf), "model")
    return rows.groupBy("model").agg(F.round(F.max("thr_0"), 6).alias("thr_0"), F.round(F.max("thr_1"), 6).alias("thr_1"),
                                     F.count(F.when(F.col("score") >= F.col("thr_0"), 1)).alias("alerts_1"), F.count(F.when(F.col("score") >= F.col("thr_1"), 1)).alias("alerts_5"))


block("hits", """
SELECT model, e.symbol, e.t0, e.severity IN ('major', 'collapse') AS severe, count(*) AS w, bool_or(alert) AS caught, min(CASE WHEN alert THEN ts END) AS first_alert,
  (e.t0 - min(CASE WHEN alert THEN ts END)) / 3600 AS lead_h
FROM clean_eps e JOIN alerts a ON a.symbol = e.symbol AND a.ts BETWEEN e.t0 - 24 * 3600 AND e.t0 - 3600 GROUP BY model, e.symbol, e.t0, e.severity""", ["clean_eps", "alerts"])


@staged
def hits(spark, sf):
    return M.episode_hits(alerts(spark, sf), T.clean_episodes(spark, sf), 24, ["model"])


block("hits72", """
SELECT model, e.symbol, e.t0, (e.t0 - min(CASE WHEN alert THEN ts END)) / 3600 AS lead_h
FROM clean_eps e JOIN alerts a ON a.symbol = e.symbol AND a.ts BETWEEN e.t0 - 72 * 3600 AND e.t0 - 3600 GROUP BY model, e.symbol, e.t0""", ["clean_eps", "alerts"])


@staged
def hits72(spark, sf):
    return M.episode_hits(alerts(spark, sf), T.clean_episodes(spark, sf), 72, ["model"])


@query("c7_episode_windows", "SELECT model, symbol, t0, severe, w, caught, lead_h FROM hits", ["hits"])
def c7(spark, sf):
    return hits.build(spark, sf).select("model", "symbol", "t0", "severe", "w", "caught", "lead_h")


@query("j5_events", """
SELECT model, episodes, round(event_recall, 6) AS event_recall, severe_episodes, round(severe_recall, 6) AS severe_recall, median_lead_h, round(alert_rate, 6) AS alert_rate, round(alert_precision, 6) AS alert_precision
FROM (SELECT model, avg(CAST(alert AS INT)) AS alert_rate, avg(y) FILTER (alert) AS alert_precision FROM alerts GROUP BY model)
LEFT JOIN (SELECT model, count(*) AS episodes, avg(CAST(caught AS INT)) AS event_recall, count(*) FILTER (severe) AS severe_episodes, avg(CAST(caught AS INT)) FILTER (severe) AS severe_recall,
  quantile_cont(lead_h, 0.5) AS median_lead_h FROM hits GROUP BY model) USING (model)""", ["alerts", "hits"])
def j5(spark, sf):
    out = M.events(alerts(spark, sf), T.clean_episodes(spark, sf), 24, ["model"])
    return rounded(out, ["model", "episodes", "event_recall", "severe_episodes", "severe_recall", "median_lead_h", "alert_rate", "alert_precision"])


block("alert_runs", """
SELECT model, symbol, min(ts) AS start, count(*) AS hours, max(y) AS y FROM (
  SELECT *, ts - 3600 * row_number() OVER (PARTITION BY model, symbol ORDER BY ts) AS g FROM alerts WHERE alert) GROUP BY model, symbol, g""", ["alerts"])


@query("e20_alert_runs", "SELECT model, symbol, start, hours, y FROM alert_runs", ["alert_runs"])
def e20(spark, sf):
    return M.runs(alerts(spark, sf).filter("alert"), ["model"])


@query("j13_run_summary", """
SELECT model, count(*) AS runs, CAST(sum(y) AS BIGINT) AS runs_with_start, round(count(*) / max(days), 6) AS runs_per_day, round(sum(y) / count(*), 6) AS run_precision
FROM alert_runs, (SELECT count(DISTINCT ts // 86400) AS days FROM test) GROUP BY model""", ["alert_runs", "test"])
def j13s(spark, sf):
    return rounded(M.run_summary(alerts(spark, sf).filter("alert"), test_rows(spark, sf), ["model"]), ["model", "runs", "runs_with_start", "runs_per_day", "run_precision"])


@query("j13_random_runs", f"""
SELECT draw, count(*) AS runs, CAST(sum(y) AS BIGINT) AS runs_with_start, round(count(*) / max(days), 6) AS runs_per_day, round(sum(y) / count(*), 6) AS run_precision FROM (
  SELECT draw, symbol, g, max(y) AS y FROM (
    SELECT *, ts - 3600 * row_number() OVER (PARTITION BY draw, symbol ORDER BY ts) AS g FROM (
      SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {UNIFORM.format("0, draw, symbol, ts")}, ts, symbol) AS rk, count(*) OVER (PARTITION BY draw) AS n
      FROM test, (SELECT unnest(generate_series(0, 49)) AS draw) WHERE model = 'rule') WHERE rk <= round_even(0.05 * n, 0)) GROUP BY draw, symbol, g),
  (SELECT count(DISTINCT ts // 86400) AS days FROM test) GROUP BY draw""", ["test"])
def j13(spark, sf):
    out = M.random_runs(test_rows(spark, sf).filter("model = 'rule'"), 0.05, 50)
    return rounded(out, ["draw", "runs", "runs_with_start", "runs_per_day", "run_precision"])


@query("j14_lead_curve", """
SELECT model, k, count(*) AS episodes, round(count(*) FILTER (lead_h >= k) / count(*), 6) AS share FROM hits72, (SELECT unnest(generate_series(1, 72)) AS k) GROUP BY model, k""", ["hits72"])
def j14(spark, sf):
    return rounded(M.lead_curve(hits72(spark, sf), ["model"], 72), ["model", "k", "episodes", "share"])


@query("j14_overtaking_hour", """
WITH c AS (SELECT model, k, count(*) FILTER (lead_h >= k) / count(*) AS share FROM hits72, (SELECT unnest(generate_series(1, 72)) AS k) GROUP BY model, k)
SELECT 'level' AS ahead, 'rule' AS behind, CASE WHEN k0 <= 72 THEN k0 END AS from_hour
FROM (SELECT coalesce(max(CASE WHEN a.share <= b.share THEN a.k END), 0) + 1 AS k0 FROM c a JOIN c b ON a.k = b.k AND a.model = 'level' AND b.model = 'rule')""", ["hits72"])
def j14o(spark, sf):
    return M.overtaking_hour(M.lead_curve(hits72(spark, sf), ["model"], 72), "level", "rule")


@query("j15_repeats", """
SELECT model, coalesce(t0 - prev <= 604800, false) AS repeat, count(*) AS episodes, count(*) FILTER (caught) AS caught
FROM hits JOIN (SELECT symbol, t0, max(t1) OVER (PARTITION BY symbol ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM clean_eps) USING (symbol, t0)
GROUP BY ALL""", ["hits", "clean_eps"])
def j15(spark, sf):
    return M.repeats(hits(spark, sf), T.clean_episodes(spark, sf), ["model"])


@query("j16_monitor", """
WITH a AS (SELECT test.* FROM test JOIN thr USING (model) WHERE model = 'rule' AND score >= thr_1),
c AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(DISTINCT ts // 86400) FROM test) AS days, (SELECT count(DISTINCT (symbol, ts // 86400)) FROM a) AS ad,
  (SELECT count(*) FROM (SELECT DISTINCT symbol, g FROM (SELECT symbol, ts - 3600 * row_number() OVER (PARTITION BY symbol ORDER BY ts) AS g FROM a))) AS r)
SELECT n AS alerts, days, round(n / days, 6) AS alerts_per_day, r AS runs, round(r / days, 6) AS runs_per_day, round(ad / days, 6) AS assets_per_day FROM c""", ["test", "thr"])
def j16(spark, sf):
    rows = test_rows(spark, sf).filter("model = 'rule'")
    over = rows.join(budgets(spark, sf), "model").filter("score >= thr_1").select(*rows.columns)
    return rounded(M.monitor(over, rows), ["alerts", "days", "alerts_per_day", "runs", "runs_per_day", "assets_per_day"])


@query("j17_close_visibility", """
SELECT severity IN ('major', 'collapse') AS severe, count(*) AS episodes, count(*) FILTER (NOT seen) AS unseen, round(avg(CAST(NOT seen AS INT)), 6) AS unseen_share
FROM (SELECT *, EXISTS (SELECT 1 FROM dev d WHERE d.symbol = e.symbol AND d.ts BETWEEN t0 AND t1 AND d.ts % 86400 = 0 AND d.dev <= -0.80014) AS seen FROM clean_eps e) GROUP BY 1""", ["clean_eps", "dev"])
def j17(spark, sf):
    return rounded(M.close_visibility(T.clean_episodes(spark, sf), T.dev(spark, sf)), ["severe", "episodes", "unseen", "unseen_share"])


block("prand", """
SELECT h.*, n, round_even(0.05 * n, 0) AS k, CASE WHEN w <= 0 THEN 0 WHEN n - w < round_even(0.05 * n, 0) THEN 1 ELSE
  1 - exp((SELECT sum(ln((n - round_even(0.05 * n, 0) - i) / (n - i))) FROM (SELECT unnest(generate_series(0, w - 1)) AS i))) END AS p
FROM hits h JOIN (SELECT model, count(*) AS n FROM test GROUP BY model) USING (model)""", ["hits", "test"])


@query("j11_random_recall", "SELECT model, symbol, t0, w, round(p, 6) AS p_random FROM prand", ["prand"])
def j11(spark, sf):
    return rounded(M.random_recall(hits(spark, sf), test_rows(spark, sf), ["model"]), ["model", "symbol", "t0", "w", "p_random"])


@query("j11_expected_runs", """
SELECT model, n, adjacent, k, round(k - adjacent * k * (k - 1) / (CAST(n AS DOUBLE) * (n - 1)), 6) AS expected_runs FROM (
  SELECT model, count(*) AS n, CAST(sum(CASE WHEN ts - p = 3600 THEN 1 ELSE 0 END) AS BIGINT) AS adjacent, CAST(round_even(0.05 * count(*), 0) AS BIGINT) AS k
  FROM (SELECT model, ts, lag(ts) OVER (PARTITION BY model, symbol ORDER BY ts) AS p FROM test) GROUP BY model)""", ["test"])
def j11e(spark, sf):
    return rounded(M.expected_runs(test_rows(spark, sf), ["model"]), ["model", "n", "adjacent", "k", "expected_runs"])


block("stake", "SELECT h.*, coalesce(x.family_collateral_usd, 0) AS c FROM hits h LEFT JOIN expo_raw x ON x.symbol = h.symbol AND x.ts = h.t0 - 3600", ["hits", "expo_raw"])


def stakes(spark, sf):
    return M.at_stake(hits(spark, sf), T.exposure_table(spark, sf), "family_collateral_usd")


@query("j12_at_stake", """
SELECT model, count(*) AS episodes, count(*) FILTER (c >= 1e4) AS with_collateral, round(sum(c), 3) AS collateral_total, round(coalesce(sum(c) FILTER (caught), 0) / sum(c), 6) AS weighted_recall,
 round(avg(CAST(caught AS INT)) FILTER (c >= 1e4), 6) AS recall_with, round(avg(CAST(caught AS INT)) FILTER (c < 1e4), 6) AS recall_without,
 round(coalesce(sum(c) FILTER (caught AND severe), 0) / sum(c) FILTER (severe), 6) AS severe_weighted_recall, round(max(c) / sum(c), 6) AS top1_share,
 round(sum(c) FILTER (r <= 5) / sum(c), 6) AS top5_share
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY c DESC, symbol, t0) AS r FROM stake) GROUP BY model""", ["stake"])
def j12(spark, sf):
    out = M.stake_summary(stakes(spark, sf), ["model"], 1e4)
    return out.select("model", "episodes", "with_collateral", F.round("collateral_total", 3).alias("collateral_total"), *[F.round(c, 6).alias(c) for c in (
        "weighted_recall", "recall_with", "recall_without", "severe_weighted_recall", "top1_share", "top5_share")])


@query("f8_largest_exposures", "SELECT symbol, t0, round(c, 3) AS collateral FROM stake WHERE model = 'rule' ORDER BY c DESC, symbol, t0 LIMIT 8", ["stake"])
def f8(spark, sf):
    return M.largest(stakes(spark, sf).filter("model = 'rule'")).select("symbol", "t0", F.round("collateral", 3).alias("collateral"))


@query("f7_deepest_fifth", """
SELECT episode_id, row_number() OVER (ORDER BY coalesce(depth_frac, -1) DESC, episode_id) <= round_even(0.2 * count(*) OVER (), 0) AS deepest FROM escalation WHERE landmark = 1""", ["escalation"])
def f7(spark, sf):
    return M.deepest_share(T.escalation(spark, sf).filter("landmark = 1")).select("episode_id", "deepest")


@query("f7_earlier_cut", """
SELECT episode_id, round(cut, 6) AS cut, coalesce(depth_frac >= cut, false) AS flag FROM escalation, (SELECT quantile_cont(depth_frac, 0.8) AS cut FROM escalation WHERE landmark = 1 AND ts <= 1705881600)
WHERE landmark = 1 AND ts > 1705881600""", ["escalation"])
def f7c(spark, sf):
    out = M.earlier_cut(T.escalation(spark, sf).filter("landmark = 1"), F.col("ts") <= T.RULES.valid_end)
    return out.select("episode_id", F.round("cut", 6).alias("cut"), "flag")


DRIFT = ("log_family_collateral_usd", "log_family_borrow_against_usd")


@query("d19_drift", " UNION ALL ".join(f"""
SELECT symbol, '{c}' AS measure, qb[1] < qa[1] OR qb[1] > qa[3] AS outside, round(abs(qb[1] - qa[2]), 6) AS change FROM (
  SELECT symbol, count(*) FILTER (split = 'train') AS na, count(*) FILTER (split = 'test') AS nb,
    count({c}) FILTER (split = 'train') AS va, count({c}) FILTER (split = 'test') AS vb,
    avg(CASE WHEN {c} <> 0 THEN 1 WHEN {c} = 0 THEN 0 END) FILTER (split = 'train') AS za,
    avg(CASE WHEN {c} <> 0 THEN 1 WHEN {c} = 0 THEN 0 END) FILTER (split = 'test') AS zb,
    quantile_cont({c}, [0.05, 0.5, 0.95]) FILTER (split = 'train') AS qa, quantile_cont({c}, [0.5]) FILTER (split = 'test') AS qb
  FROM onset WHERE has_exposure > 0 GROUP BY symbol) WHERE na >= 20 AND nb >= 20 AND va >= 10 AND vb >= 10 AND (za >= 0.5 OR zb >= 0.5)""" for c in DRIFT), ["onset"])
def d19(spark, sf):
    return rounded(M.drift(T.onset(spark, sf), DRIFT, 20, 10), ["symbol", "measure", "outside", "change"])


# ------------------------------------------------------------------------------------------------ pair rankings
@staged
def scored_pairs(spark, sf):
    """Pairs with known outcome, history features and two rankers: own follow share and the seed's."""
    rows = T.pairs(spark, sf).filter("y168 is not null")
    rows = B.follow(rows, T.clean_episodes(spark, sf)).select("seed_id", "seed_severity", "cluster", "split", "cand", "seed", "tau", "y72", "y168", "follow_rate", "codepeg_share")
    return rows


block("spairs", "SELECT p.*, follow_rate, codepeg_share FROM pairs p JOIN follow USING (seed_id, cand, tau) WHERE y168 IS NOT NULL", ["pairs", "follow"])


def rankers(spark, sf):
    base = scored_pairs(spark, sf)
    long = base.select("*", F.explode(F.create_map(F.lit("follow"), F.round("follow_rate", 9), F.lit("codepeg"), F.round("codepeg_share", 9))).alias("model", "raw"))
    return M.with_jitter(long, F.col("raw"))


def plain_rankers(spark, sf):
    """The same rankers with an MD5 tie-breaker, which the SQL side can compute too (it has no CRC)."""
    long = scored_pairs(spark, sf).select("*", F.explode(F.create_map(F.lit("follow"), F.round("follow_rate", 9), F.lit("codepeg"), F.round("codepeg_share", 9))).alias("model", "raw"))
    return long.withColumn("score", F.col("raw") + S.hash_uniform(F.lit(1), "seed_id", "cand") * 1e-9)


block("ranked", f"""
SELECT *, raw + {UNIFORM.format("1, seed_id, cand")} * 1e-9::DOUBLE AS score FROM (
  SELECT seed_id, seed_severity, cluster, cand, y168, 'follow' AS model, round(follow_rate, 9) AS raw FROM spairs
  UNION ALL SELECT seed_id, seed_severity, cluster, cand, y168, 'codepeg', round(codepeg_share, 9) FROM spairs)""", ["spairs"])
RANK = ["p5", "hit5", "ndcg10", "ap"]


def rank_sql(source, by):
    return f"""
SELECT {by}, cluster, candidates, followers, top / least(5, candidates) AS p5, CAST(top > 0 AS DOUBLE) AS hit5,
  gain / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(generate_series(1, CAST(least(followers, 10) AS BIGINT))) AS i)) AS ndcg10, ap
FROM (
  SELECT {by}, min(cluster) AS cluster, count(*) AS candidates, CAST(sum(y) AS BIGINT) AS followers, sum(y) FILTER (r <= 5) AS top,
         coalesce(sum(y / log2(r + 1)) FILTER (r <= 10), 0) AS gain, sum(y * ctp / r) / nullif(sum(y), 0) AS ap
  FROM (SELECT *, sum(y) OVER (PARTITION BY {by} ORDER BY score DESC, cand ROWS UNBOUNDED PRECEDING) AS ctp FROM (
    SELECT *, y168 AS y, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, cand) AS r FROM {source})) GROUP BY {by}) WHERE followers > 0"""


block("rank", rank_sql("ranked", "model, seed_id"), ["ranked"])


@staged
def ranking(spark, sf):
    return M.ranking(plain_rankers(spark, sf), ["model"])


@query("j6_ranking", "SELECT model, seed_id, cluster, candidates, followers, " + ", ".join(f"round({c}, 6) AS {c}" for c in RANK) + " FROM rank", ["rank"])
def j6(spark, sf):
    return rounded(ranking.build(spark, sf), ["model", "seed_id", "cluster", "candidates", "followers", *RANK])


# the table of the reflected CRC-32 polynomial, and the sum of a text without other than ASCII characters
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(txt, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INT) + 1])), 4294967295)"


@query("f3_top_k_jitter", f"""
SELECT model, seed_id, cand, CAST(row_number() OVER w AS INTEGER) AS rank FROM (
  SELECT model, seed_id, cand, raw + {CRC} / 4294967296 * 1e-9 AS score FROM (
    SELECT unnest(['follow', 'codepeg']) AS model, unnest([round(follow_rate, 9), round(codepeg_share, 9)]) AS raw, seed_id, cand, seed_id || '|' || cand AS txt FROM spairs),
    (SELECT {CRC_TABLE} AS t))
WINDOW w AS (PARTITION BY model, seed_id ORDER BY score DESC, cand) QUALIFY rank <= 5""", ["spairs"])
def f3(spark, sf):
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("model", "seed_id").orderBy(F.desc("score"), "cand"))
    return rankers(spark, sf).withColumn("rank", rank).filter("rank <= 5").select("model", "seed_id", "cand", "rank")


@query("j7_random_baseline", "SELECT seed_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in RANK) + " FROM ("
       + rank_sql(f"(SELECT p.*, draw, {UNIFORM.format('0, draw, seed_id, cand')} AS score FROM spairs p, (SELECT unnest(generate_series(0, 199)) AS draw))", "draw, seed_id") + ") GROUP BY seed_id", ["spairs"])
def j7(spark, sf):
    return rounded(M.random_ranking(scored_pairs(spark, sf), 200), ["seed_id", *RANK])


@query("f6_case_studies", """
SELECT seed_id, string_agg(cand || CASE WHEN y168 = 1 THEN '*' ELSE '' END, ', ' ORDER BY r) FILTER (r <= 5) AS top, coalesce(string_agg(cand, ', ' ORDER BY cand) FILTER (y168 = 1), '') AS followers
FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, cand) AS r FROM ranked WHERE model = 'follow' AND seed_severity = 'collapse') GROUP BY seed_id""", ["ranked"])
def f6(spark, sf):
    return M.case_studies(plain_rankers(spark, sf).filter("model = 'follow'"))


@query("j18_seed_changes", """
SELECT count(*) AS seeds, round(avg(d), 6) AS mean_change, count(*) FILTER (abs(d) > 1e-12) AS moved, round((sum(d) - max(d)) / (count(*) - 1), 6) AS mean_without_largest
FROM (SELECT a.ap - b.ap AS d FROM rank a JOIN rank b ON a.seed_id = b.seed_id AND a.model = 'follow' AND b.model = 'codepeg')""", ["rank"])
def j18(spark, sf):
    return rounded(M.seed_changes(ranking(spark, sf), "follow", "codepeg"), ["seeds", "mean_change", "moved", "mean_without_largest"])


# ------------------------------------------------------------------------------------------------ bootstraps
def weights_sql(ids, draws=DRAWS, seed=0):
    return f"""SELECT draw, key, count(*) AS weight FROM (
  SELECT draw, CAST(floor({UNIFORM.format(f"{seed}, draw, idx")} * n) AS BIGINT) AS pick FROM {ids}, (SELECT unnest(generate_series(0, {draws - 1})) AS draw)) s
  JOIN {ids} i ON i.idx = pick GROUP BY draw, key"""


block("seed_ids", "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT cluster AS key FROM spairs)", ["spairs"])
block("seed_w", weights_sql("seed_ids"), ["seed_ids"])
block("rank_ids", "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT cluster AS key FROM rank)", ["rank"])
block("rank_w", weights_sql("rank_ids"), ["rank_ids"])
block("asset_ids", "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT symbol AS key FROM test)", ["test"])
block("asset_w", weights_sql("asset_ids"), ["asset_ids"])


@query("j8_draw_weights", "SELECT draw, key AS cluster, weight FROM seed_w", ["seed_w"])
def j8w(spark, sf):
    return R.draw_weights(scored_pairs(spark, sf), "cluster", DRAWS)


@query("j8_bootstrap_mean", """
SELECT p.model, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CAST(m > 0 AS INT)), 6) AS share_above_0, count(m) AS draws
FROM (SELECT model, avg(ap) AS mean FROM rank GROUP BY model) p
JOIN (SELECT model, draw, sum(weight * ap) / sum(weight) AS m FROM rank JOIN rank_w ON key = cluster GROUP BY model, draw) d ON d.model = p.model GROUP BY p.model, mean""", ["rank", "rank_w"])
def j8m(spark, sf):
    out = R.bootstrap_mean(ranking(spark, sf), "cluster", "ap", DRAWS, by=["model"])
    return rounded(out, ["model", "mean", "low", "high", "share_above_0", "draws"])


block("boot_ap", ap_sql("(SELECT model, draw, score, y, weight FROM test JOIN asset_w ON key = symbol)", "model, draw", "weight"), ["test", "asset_w"])


@query("j8_bootstrap_ap", "SELECT model, draw, round(ap, 6) AS ap FROM boot_ap", ["boot_ap"])
def j8a(spark, sf):
    return rounded(R.bootstrap_ap(test_rows(spark, sf), "symbol", DRAWS, by=["model"]), ["model", "draw", "ap"])


@query("c18_paired_rows", "SELECT count(*) AS matched, 0 AS only_a, 0 AS only_b, 0 AS repeated FROM test WHERE model = 'rule'", ["test"])
def c18(spark, sf):
    t = test_rows(spark, sf)
    return R.one_to_one(t.filter("model = 'rule'"), t.filter("model = 'level'"), ["symbol", "ts"]).select(
        "matched", *[F.col(c).cast("int").alias(c) for c in ("only_a", "only_b", "repeated")])


@query("j8_paired_ap", """
SELECT rows, positives, round(a, 6) AS ap_a, round(b, 6) AS ap_b, round(a - b, 6) AS diff, round(lo, 6) AS low, round(hi, 6) AS high, round(sh, 6) AS share_above_0, draws FROM
 (SELECT max(ap) FILTER (model = 'level') AS a, max(ap) FILTER (model = 'rule') AS b, CAST(max(rows) AS BIGINT) AS rows, CAST(max(positives) AS BIGINT) AS positives FROM ap WHERE split = 'test'),
 (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CAST(d > 0 AS INT)) AS sh, count(*) AS draws FROM (
   SELECT draw, max(ap) FILTER (model = 'level') - max(ap) FILTER (model = 'rule') AS d FROM boot_ap GROUP BY draw) WHERE d IS NOT NULL)""", ["ap", "boot_ap"])
def j8p(spark, sf):
    t = test_rows(spark, sf)
    out = R.paired_ap(t.filter("model = 'level'"), t.filter("model = 'rule'"), DRAWS)
    return rounded(out, ["rows", "positives", "ap_a", "ap_b", "diff", "low", "high", "share_above_0", "draws"])


@staged
def linked_pairs(spark, sf):
    lk = links(spark, sf).select("seed_id", F.col("cand_asset").alias("cand"), "same_family", "log_vault_overlap", "log_pool_overlap", "log_lend_cand_vs_seed", "shared_vaults")
    return scored_pairs(spark, sf).join(lk, ["seed_id", "cand"])


block("lpairs", "SELECT p.*, same_family, log_vault_overlap, log_pool_overlap, log_lend_cand_vs_seed, shared_vaults FROM spairs p JOIN links l ON l.seed_id = p.seed_id AND l.cand_asset = p.cand", ["spairs", "links"])


@query("j9_link_rates", """
WITH s AS (SELECT cluster, sum(y168) FILTER (log_vault_overlap > 0) AS sl, count(*) FILTER (log_vault_overlap > 0) AS nl, sum(y168) FILTER (NOT log_vault_overlap > 0) AS su, count(*) FILTER (NOT log_vault_overlap > 0) AS nu FROM lpairs GROUP BY cluster),
d AS (SELECT draw, sum(weight * coalesce(sl, 0)) / nullif(sum(weight * nl), 0) - sum(weight * coalesce(su, 0)) / nullif(sum(weight * nu), 0) AS d FROM s JOIN seed_w ON key = cluster GROUP BY draw)
SELECT CAST(nl AS BIGINT) AS linked_pairs, CAST(sl AS BIGINT) AS linked_followers, round(sl / nl, 6) AS rate_linked, round(su / nu, 6) AS rate_unlinked, round(sl / nl - su / nu, 6) AS difference,
  round(lo, 6) AS low, round(hi, 6) AS high, n AS draws
FROM (SELECT sum(nl) AS nl, sum(sl) AS sl, sum(su) AS su, sum(nu) AS nu FROM s), (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, count(d) AS n FROM d)""", ["lpairs", "seed_w"])
def j9(spark, sf):
    out = R.link_rates(linked_pairs(spark, sf), F.col("log_vault_overlap") > 0, "y168", DRAWS)
    return rounded(out, ["linked_pairs", "linked_followers", "rate_linked", "rate_unlinked", "difference", "low", "high", "draws"])


@query("j23_feature_follows", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS pairs, CAST(coalesce(sum(y168), 0) AS BIGINT) AS followed FROM lpairs WHERE {c} <> 0 HAVING count(*) > 0" for c in ("log_vault_overlap", "log_pool_overlap", "log_lend_cand_vs_seed", "shared_vaults")), ["lpairs"])
def j23(spark, sf):
    return M.feature_follows(linked_pairs(spark, sf), ["log_vault_overlap", "log_pool_overlap", "log_lend_cand_vs_seed", "shared_vaults"])


SHIFTS = (-28, -21, -14, 14, 21, 28)
block("ppairs", f"""
SELECT s.cluster, s.shift, a.symbol AS cand, CAST(EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.t0 > s.tau AND e.t0 <= s.tau + 604800) AS INT) AS y168,
  NOT EXISTS (SELECT 1 FROM seeds q WHERE q.tau BETWEEN s.tau - 604800 AND s.tau + 604800) AS calm
FROM (SELECT seed, cluster, shift, tau + shift * 86400 AS tau FROM seeds, (SELECT unnest({list(SHIFTS)}) AS shift)) s, (SELECT DISTINCT symbol FROM dev) a
WHERE a.symbol <> s.seed AND s.tau + 604800 <= (SELECT max(ts) FROM dev)
  AND EXISTS (SELECT 1 FROM dev d WHERE d.symbol = a.symbol AND dev IS NOT NULL AND d.ts BETWEEN s.tau - 86400 AND s.tau)
  AND NOT EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.t0 <= s.tau AND e.t1 > s.tau - 86400)
  AND NOT EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.terminal AND e.t0 <= s.tau)""", ["seeds", "clean_eps", "dev"])


def placebo(spark, sf):
    return R.placebo_pairs(T.seeds(spark, sf), T.clean_episodes(spark, sf), T.dev(spark, sf), SHIFTS)


@query("j10_placebo_pairs", "SELECT shift, calm, count(*) AS pairs, CAST(sum(y168) AS BIGINT) AS followers FROM ppairs GROUP BY shift, calm", ["ppairs"])
def j10p(spark, sf):
    return placebo(spark, sf).groupBy("shift", "calm").agg(F.count("*").alias("pairs"), F.sum("y168").alias("followers"))


block("psub", "SELECT *, unnest(['all', CASE WHEN calm THEN 'calm' ELSE 'near' END, CASE WHEN shift < 0 THEN 'before' ELSE 'after' END]) AS subset FROM ppairs", ["ppairs"])


@query("j10_placebo_rates", """
WITH a AS (SELECT cluster, sum(y168) AS sa, count(*) AS na FROM spairs GROUP BY cluster), p AS (SELECT subset, cluster, sum(y168) AS sp, count(*) AS np FROM psub GROUP BY ALL),
d AS (
  SELECT s.subset, w.draw, sum(weight * sa) / sum(weight * na) AS fa, coalesce(sum(weight * sp), 0) / greatest(coalesce(sum(weight * np), 0), 1) AS fp
  FROM (SELECT DISTINCT subset FROM p) s, seed_w w JOIN a ON a.cluster = w.key LEFT JOIN p ON p.cluster = w.key AND p.subset = s.subset GROUP BY ALL),
c AS (SELECT subset, quantile_cont(fa - fp, [0.025, 0.975]) AS dq, quantile_cont(CASE WHEN fp > 0 THEN fa / fp END, [0.025, 0.975]) AS rq, avg(CAST(fa - fp <= 0 AS INT)) AS le FROM d GROUP BY subset)
SELECT subset, CAST(sum(np) AS BIGINT) AS placebo_pairs, CAST(sum(sp) AS BIGINT) AS placebo_followers, round(max(f), 6) AS follow_rate, round(sum(sp) / sum(np), 6) AS placebo_rate,
  round(max(f) - sum(sp) / sum(np), 6) AS diff, round(max(f) / nullif(sum(sp) / sum(np), 0), 6) AS ratio, round(max(dq[1]), 6) AS diff_low, round(max(dq[2]), 6) AS diff_high,
  round(max(rq[1]), 6) AS ratio_low, round(max(rq[2]), 6) AS ratio_high, round(max(le), 6) AS share_le_0
FROM p JOIN c USING (subset), (SELECT avg(y168) AS f FROM spairs) GROUP BY subset""", ["spairs", "psub", "seed_w"])
def j10(spark, sf):
    out = R.placebo_rates(scored_pairs(spark, sf), placebo(spark, sf), DRAWS)
    return rounded(out, ["subset", "placebo_pairs", "placebo_followers", "follow_rate", "placebo_rate", "diff", "ratio", "diff_low", "diff_high", "ratio_low", "ratio_high", "share_le_0"])


@query("d22_flatten_results", """
SELECT model AS "group", split AS label, round(ap, 4) AS difference, round(ap, 4) - 1 AS low, round(ap, 4) + 1 AS high, CASE WHEN split = 'test' THEN round(ap, 4) * 2 END AS robust_difference FROM ap""", ["ap"])
def d22(spark, sf):
    ap = M.average_precision(preds(spark, sf), ["model", "split"]).select("model", "split", F.round("ap", 4).alias("ap"))
    main = ap.select(F.to_json(F.create_map("model", F.create_map("split", F.struct(F.col("ap").alias("diff"), F.array(F.col("ap") - 1, F.col("ap") + 1).alias("ci"))))).alias("body"))
    robust = ap.filter("split = 'test'").select(F.to_json(F.create_map("model", F.create_map("split", F.struct((F.col("ap") * 2).alias("diff"), F.array(F.col("ap"), F.col("ap")).alias("ci"))))).alias("body"))
    return M.flatten_results(main, robust).select("group", "label", "difference", "low", "high", "robust_difference")


@query("a10_prediction_sink", "SELECT model, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM preds GROUP BY model", ["preds"])
def a10(spark, sf):
    import uuid

    from pegwatch.session import shared_folder
    path = f"{shared_folder(spark)}/tables/preds-{uuid.uuid4().hex}"
    preds(spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("rows"), F.sum("y").alias("positives"))
