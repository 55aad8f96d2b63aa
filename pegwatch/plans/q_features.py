"""Queries on features and on the escalation and contagion tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pegwatch.operators import features as X
from pegwatch.operators import tables as B
from pegwatch.plans import standins as T
from pegwatch.plans.q_series import r
from pegwatch.plans.registry import query


def rounded(df, keep, n=6):
    types = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), n).alias(c) if types[c] == "double" else F.col(c) for c in keep])


def frame(n, keys="symbol"):
    return f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def capped(past: str, cap: int) -> str:
    """Time since an event up to a cap; unknown before the first (least() alone would skip the NULL)."""
    return f"CASE WHEN {past} IS NOT NULL THEN least({past}, {cap}) END"


ROLL = {"z_now": "z"}
ROLL |= {f"z_min_{w}h": f"min(z) OVER {frame(w)}" for w in (6, 24, 72, 168)}
ROLL["z_max_24h"] = f"max(z) OVER {frame(24)}"
for _w in (24, 168):
    ROLL[f"z_mean_{_w}h"] = f"avg(z) OVER {frame(_w)}"
    ROLL[f"z_std_{_w}h"] = f"CASE WHEN count(z) OVER {frame(_w)} >= 6 THEN stddev_samp(z) OVER {frame(_w)} END"
ROLL |= {f"z_chg_{k}h": f"z - lag(z, {k}) OVER (PARTITION BY symbol ORDER BY ts)" for k in (1, 6, 24)}
ROLL["z_vs_mean_168h"] = f"z - avg(z) OVER {frame(168)}"
NEAR = "CASE WHEN z IS NOT NULL THEN CAST(z < -0.5 AS INT) END"
ROLL["near_miss_168h"] = f"CAST(sum({NEAR}) OVER {frame(168)} AS DOUBLE)"
ROLL["near_frac_24h"] = f"avg({NEAR}) OVER {frame(24)}"
ROLL["hours_since_near_miss"] = capped(f"(ts - max(CASE WHEN z < -0.5 THEN ts END) OVER {frame(10**6)}) / 3600", 2160)
ROLL["missing_frac_24h"] = f"avg(CAST(z IS NULL AS INT)) OVER {frame(24)}"
T.block("rolling", "SELECT symbol, ts, " + ", ".join(f"{v} AS {k}" for k, v in ROLL.items()) + " FROM z", ["z"])


def rounds(names):
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


@query("b6_threshold_units", "SELECT symbol, ts, round(z, 6) AS z FROM z", ["z"])
def b6(spark, sf):
    return T.z(spark, sf).select("symbol", "ts", r("z"))


@query("e9_e12_rolling", f"SELECT symbol, ts, {rounds(ROLL)} FROM rolling", ["rolling"])
def e9(spark, sf):
    return rounded(X.rolling(T.z(spark, sf)), ["symbol", "ts", *ROLL])


HIST = [f"episodes_{d}d" for d in (30, 90, 365)]
T.block("history", "SELECT symbol, ts, " + ", ".join(
    f"CAST(sum(coalesce(n, 0)) OVER {frame(24 * d)} AS BIGINT) AS episodes_{d}d" for d in (30, 90, 365)) + f""",
 {capped(f"(ts - max(CASE WHEN n > 0 THEN ts END) OVER {frame(10**6)}) / 3600", 8760)} AS hours_since_episode
FROM z LEFT JOIN (SELECT symbol, tk AS ts, count(*) AS n FROM clean_eps GROUP BY ALL) USING (symbol, ts)""", ["z", "clean_eps"])


@query("e13_history", f"SELECT symbol, ts, {', '.join(HIST)}, round(hours_since_episode, 6) AS hours_since_episode FROM history", ["history"])
def e13(spark, sf):
    return rounded(X.history(T.clean_episodes(spark, sf), T.z(spark, sf)), ["symbol", "ts", *HIST, "hours_since_episode"])


MKT = ["mkt_stress_frac", "mkt_mean_z_usd", "mkt_episodes_24h", "mkt_episodes_168h", "eth_ret_1h", "eth_ret_24h", "eth_ret_168h", "eth_vol_24h"]
T.block("market", """
SELECT *, CASE WHEN count(step) OVER w24 >= 12 THEN stddev_samp(step) OVER w24 END AS eth_vol_24h
FROM (
  SELECT ts, mkt_stress_frac, mkt_mean_z_usd, ln(price) - lag(ln(price), 1) OVER o AS step,
    CAST(sum(coalesce(n, 0)) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS mkt_episodes_24h,
    CAST(sum(coalesce(n, 0)) OVER (ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS BIGINT) AS mkt_episodes_168h,
    ln(price) - lag(ln(price), 1) OVER o AS eth_ret_1h, ln(price) - lag(ln(price), 24) OVER o AS eth_ret_24h,
    ln(price) - lag(ln(price), 168) OVER o AS eth_ret_168h
  FROM (
    SELECT c.*, n, CASE WHEN c.ts - b.ts <= 7200 THEN b.price END AS price
    FROM (SELECT ts, count(*) FILTER (z < -0.5) / nullif(count(z), 0) AS mkt_stress_frac,
                 avg(greatest(least(z, 5), -5)) FILTER (peg = 'USD' AND z IS NOT NULL) AS mkt_mean_z_usd
          FROM z JOIN registry USING (symbol) GROUP BY ts) c
    LEFT JOIN (SELECT tk AS ts, count(*) AS n FROM clean_eps GROUP BY tk) k USING (ts)
    ASOF LEFT JOIN (SELECT ts, price FROM prices WHERE symbol = 'view_0' AND source = 'main') b ON c.ts >= b.ts
  ) WINDOW o AS (ORDER BY ts)
) WINDOW w24 AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
""", ["z", "registry", "clean_eps", "prices"])


@query("e14_e15_market", "SELECT ts, mkt_episodes_24h, mkt_episodes_168h, " + rounds([c for c in MKT if "episodes" not in c]) + " FROM market", ["market"])
def e14(spark, sf):
    m = X.market(T.z(spark, sf), T.clean_episodes(spark, sf), T.base_prices(spark, sf), T.usd_assets(spark, sf))
    return rounded(m, ["ts", *MKT])


@query("c17_wrapped", """
SELECT w.symbol, u.ts, round(u.z_now, 6) AS und_z_now, round(u.z_min_24h, 6) AS und_z_min_24h
FROM registry w JOIN rolling u ON u.symbol = w.category || '_0' WHERE suffix(w.symbol, '_1')""", ["registry", "rolling"])
def c17(spark, sf):
    return rounded(X.wrapped(X.rolling(T.z(spark, sf)), T.wrapper_pairs(spark, sf), ["z_now", "z_min_24h"]),
                   ["symbol", "ts", "und_z_now", "und_z_min_24h"])


EXPO = [f"log_{c}" for c in T.EXPO_USD] + list(T.EXPO_RAW) + [f"dlog_{c}_{k}h" for c in T.EXPO_CHANGE for k in (24, 72, 168)] + [
    "borrow_to_collateral", "family_borrow_to_collateral", "has_exposure"]
T.block("expo", "SELECT symbol, ts, " + ", ".join(
    [f"ln(1 + greatest({c}, 0) * CASE WHEN {c} IS NULL THEN NULL ELSE 1 END) AS log_{c}" for c in T.EXPO_USD] + list(T.EXPO_RAW)
    + [f"ln(1 + {c}) - lag(ln(1 + {c}), {k}) OVER (PARTITION BY symbol ORDER BY ts) AS dlog_{c}_{k}h" for c in T.EXPO_CHANGE for k in (24, 72, 168)]
    + ["CASE WHEN mm_collateral_usd >= 1e4 THEN mm_borrow_against_usd / mm_collateral_usd END AS borrow_to_collateral",
       "CASE WHEN family_collateral_usd >= 1e4 THEN family_borrow_against_usd / family_collateral_usd END AS family_borrow_to_collateral",
       "CAST(coalesce(family_collateral_usd, 0) > 0 OR coalesce(mm_supply_usd, 0) > 0 OR aave_supply_usd > 0 AS DOUBLE) AS has_exposure"]) + " FROM expo_raw",
        ["expo_raw"])


@query("b7_b9_exposure", f"SELECT symbol, ts, {rounds(EXPO)} FROM expo", ["expo"])
def b7(spark, sf):
    return rounded(X.exposure(T.exposure_table(spark, sf), T.EXPO_USD, T.EXPO_CHANGE, T.EXPO_RAW), ["symbol", "ts", *EXPO])


CATS = [f"cat_{c}" for c in T.CATEGORIES]
ONSET = ["peg_eth", *CATS, *ROLL, "hours_since_episode", *[c for c in MKT if "episodes" not in c], "und_z_now", "und_z_min_24h", *EXPO]
T.block("onset", f"""
SELECT l.symbol, l.ts, y24, y72, in_episode, CAST(peg = 'ETH' AS DOUBLE) AS peg_eth,
  {', '.join(f"CAST(category = '{c}' AS DOUBLE) AS cat_{c}" for c in T.CATEGORIES)},
  r.* EXCLUDE (symbol, ts), h.* EXCLUDE (symbol, ts), m.* EXCLUDE (ts, step), u.z_now AS und_z_now, u.z_min_24h AS und_z_min_24h,
  x.* EXCLUDE (symbol, ts, has_exposure), coalesce(has_exposure, 0) AS has_exposure,
  CASE WHEN l.ts <= 1705276800 THEN 'train' WHEN l.ts <= 1705881600 THEN 'valid' ELSE 'test' END AS split
FROM labels l JOIN rolling r ON r.symbol = l.symbol AND r.ts = l.ts JOIN history h ON h.symbol = l.symbol AND h.ts = l.ts
JOIN market m ON m.ts = l.ts LEFT JOIN rolling u ON suffix(l.symbol, '_1') AND u.symbol = category || '_0' AND u.ts = l.ts
LEFT JOIN expo x ON x.symbol = l.symbol AND x.ts = l.ts
WHERE y24 IS NOT NULL OR y72 IS NOT NULL""", ["labels", "rolling", "history", "market", "expo"])


@query("b10_c16_onset_table", f"SELECT symbol, ts, y24, y72, in_episode, split, {', '.join(HIST)}, mkt_episodes_24h, mkt_episodes_168h, {rounds(ONSET)} FROM onset", ["onset"])
def b10(spark, sf):
    return rounded(T.onset.build(spark, sf), ["symbol", "ts", "y24", "y72", "in_episode", "split", *HIST, "mkt_episodes_24h", "mkt_episodes_168h", *ONSET])


@query("b11_d20_split_summary", """
SELECT split, count(*) AS rows, count(*) FILTER (y24 = 1) AS positives, count(DISTINCT symbol) AS assets FROM onset GROUP BY split""", ["onset"])
def d20(spark, sf):
    return X.split_summary(T.onset(spark, sf), "y24")


DAILY = {"dz_now": "z"}
DAILY |= {f"dz_min_{w}d": f"min(z) OVER {frame(w)}" for w in (3, 7, 30)}
DAILY["dz_max_7d"] = f"max(z) OVER {frame(7)}"
for _w in (7, 30):
    DAILY[f"dz_mean_{_w}d"] = f"avg(z) OVER {frame(_w)}"
    DAILY[f"dz_std_{_w}d"] = f"CASE WHEN count(z) OVER {frame(_w)} >= 3 THEN stddev_samp(z) OVER {frame(_w)} END"
DAILY |= {f"dz_chg_{k}d": f"z - lag(z, {k}) OVER (PARTITION BY symbol ORDER BY ts)" for k in (1, 7)}
DAILY["dz_vs_mean_30d"] = f"z - avg(z) OVER {frame(30)}"
DAILY["d_near_30d"] = f"CAST(sum({NEAR}) OVER {frame(30)} AS DOUBLE)"
DAILY |= {f"d_beyond_{w}d": f"CAST(sum(CASE WHEN z IS NOT NULL THEN CAST(z <= -1 AS INT) END) OVER {frame(w)} AS DOUBLE)" for w in (30, 90, 365)}
DAILY["d_days_since_near"] = capped(f"(ts - max(CASE WHEN z < -0.5 THEN ts END) OVER {frame(10**6)}) / 86400", 365)
DAILY["d_days_since_beyond"] = capped(f"(ts - max(CASE WHEN z <= -1 THEN ts END) OVER {frame(10**6)}) / 86400", 365)
DAILY["d_missing_frac_7d"] = f"avg(CAST(z IS NULL AS INT)) OVER {frame(7)}"
T.block("zday", """
SELECT symbol, ts, CASE WHEN dev IS NOT NULL THEN greatest(least(dev, 1), -1) / theta END AS z
FROM (SELECT symbol, unnest(generate_series(a, b, 86400)) AS ts FROM (SELECT DISTINCT symbol FROM dev WHERE ts % 86400 = 0),
      (SELECT CAST(ceil(min(ts) / 86400) AS BIGINT) * 86400 AS a, max(ts) // 86400 * 86400 AS b FROM dev))
LEFT JOIN (SELECT symbol, ts, dev, theta FROM dev) USING (symbol, ts)""", ["dev"])


@query("e16_daily", "SELECT symbol, ts, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in DAILY.items()) + " FROM zday", ["zday"])
def e16(spark, sf):
    return rounded(X.daily(X.daily_closes(T.dev(spark, sf))), ["symbol", "ts", *DAILY])


@query("e16_daily_market", """
SELECT ts, round(stress, 6) AS d_mkt_stress_frac, round(mz, 6) AS d_mkt_mean_z_usd, beyond AS d_mkt_beyond_1d,
  CAST(sum(beyond) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS d_mkt_beyond_7d, round(step, 6) AS d_eth_ret_1d,
  round(lp - lag(lp, 7) OVER (ORDER BY ts), 6) AS d_eth_ret_7d,
  round(CASE WHEN count(step) OVER w >= 10 THEN stddev_samp(step) OVER w END, 6) AS d_eth_vol_30d
FROM (SELECT *, lp - lag(lp) OVER (ORDER BY ts) AS step FROM (
  SELECT c.*, CASE WHEN c.ts - b.ts <= 7200 THEN ln(b.price) END AS lp
  FROM (SELECT ts, count(*) FILTER (z < -0.5) / nullif(count(z), 0) AS stress,
               avg(greatest(least(z, 5), -5)) FILTER (peg = 'USD' AND z IS NOT NULL) AS mz, count(*) FILTER (z <= -1) AS beyond
        FROM zday JOIN registry USING (symbol) GROUP BY ts) c
  ASOF LEFT JOIN (SELECT ts, price FROM prices WHERE symbol = 'view_0' AND source = 'main') b ON c.ts >= b.ts))
WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", ["zday", "registry", "prices"])
def e16m(spark, sf):
    m = X.daily_market(X.daily_closes(T.dev(spark, sf)), T.base_prices(spark, sf), T.usd_assets(spark, sf))
    return rounded(m, m.columns)


# ------------------------------------------------------------------------------------------------ escalation
T.block("dev_raw", "SELECT * FROM dev", ["dev"])
T.block("escalation", """
WITH dev AS (
  SELECT symbol, ts, CASE WHEN dev IS NOT NULL THEN greatest(least(dev, 1), -1) END AS dev, CASE WHEN dev_obs IS NOT NULL THEN greatest(least(dev_obs, 1), -1) END AS dev_obs FROM dev_raw
), hist AS (
  SELECT *, (t1 - t0) / 3600 + 1 AS dur, severity IN ('major', 'collapse') AS sev, count(*) OVER p AS n,
    coalesce(count(*) FILTER (severity IN ('major', 'collapse')) OVER p, 0) AS n_sev,
    coalesce(count(*) FILTER ((t1 - t0) / 3600 + 1 >= 24) OVER p, 0) AS n_long,
    coalesce(max(greatest(0, -held_min_dev) / 0.60007) FILTER (held_min_dev IS NOT NULL) OVER p, 0) AS deepest,
    lag(t1) OVER (PARTITION BY symbol ORDER BY t0) AS prev_end
  FROM clean_eps JOIN (SELECT symbol, min(ts) AS seen FROM dev WHERE dev IS NOT NULL GROUP BY symbol) USING (symbol)
  WINDOW p AS (PARTITION BY symbol ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rows AS (
  SELECT *, greatest(t0 + landmark * 3600, tk) AS ts FROM hist, (SELECT unnest([1, 6, 24]) AS landmark)
), state AS (
  SELECT r.symbol, r.t0, r.landmark, min(d.dev) FILTER (d.ts >= t0) AS mn, max(d.dev) FILTER (d.ts = t0) AS first,
    count(*) FILTER (d.ts >= t0 AND d.dev <= -0.80014) AS below, max(d.dev) FILTER (d.ts = r.ts) AS now,
    min(d.dev) FILTER (d.ts < t0 AND d.ts >= t0 - 86400) AS pmin, avg(d.dev) FILTER (d.ts < t0) AS pmean
  FROM rows r JOIN dev d ON d.symbol = r.symbol AND d.ts BETWEEN r.t0 - 604800 AND r.ts GROUP BY ALL
), held AS (
  SELECT symbol, t0, landmark, min(greatest(dev_obs, p)) FILTER (p IS NOT NULL) AS held FROM (
    SELECT r.symbol, r.t0, r.landmark, dev_obs, lag(dev_obs) OVER (PARTITION BY r.symbol, r.t0, r.landmark ORDER BY d.ts) AS p
    FROM rows r JOIN dev d ON d.symbol = r.symbol AND d.ts BETWEEN r.t0 AND r.ts WHERE dev_obs IS NOT NULL) GROUP BY ALL
)
SELECT symbol || '@' || t0 AS episode_id, symbol, t0, landmark, ts, severity, held_min_dev, dur AS duration_h, ongoing,
  coalesce(held <= -0.60007, false) AS decided_severe,
  CASE WHEN NOT (coalesce(held <= -0.60007, false) OR (ongoing AND NOT sev)) THEN CAST(sev AS INT) END AS y_severe,
  CASE WHEN NOT (landmark >= 23 OR (ongoing AND dur < 24)) THEN CAST(dur >= 24 AS INT) END AS y_long,
  CASE WHEN mn IS NOT NULL THEN greatest(0, -mn) / 0.60007 END AS depth_frac, first / 0.80014 AS ep_z_first, coalesce(below, 0) AS ep_hours_below,
  CASE WHEN now IS NOT NULL THEN CAST(now > -0.80014 * 0.5 AS INT) END AS ep_back_in_band,
  pmin / 0.80014 AS pre_z_min_24h, pmean / 0.80014 AS pre_z_mean_168h,
  n AS prior_episodes, n_sev AS prior_severe, n_long AS prior_long, (n_sev + 1) / (n + 5) AS prior_severe_share,
  (n_long + 1) / (n + 5) AS prior_long_share, deepest AS prior_max_depth_frac, (ts - prev_end) / 3600 AS hours_since_prior_end,
  (ts - seen) / 86400 AS asset_age_days, ln(1 + n) AS log_prior_episodes, ln(1 + (ts - seen) / 86400) AS log_asset_age_days,
  CASE WHEN suffix(symbol, '_1') AND EXISTS (SELECT 1 FROM z WHERE z.symbol = split_part(rows.symbol, '_', 1) || '_0' AND z.ts = rows.ts AND z.z <= -1) THEN CAST(1 AS DOUBLE) ELSE 0 END AS und_below
FROM rows LEFT JOIN state USING (symbol, t0, landmark) LEFT JOIN held USING (symbol, t0, landmark)""", ["clean_eps", "dev_raw", "z"])
ESC_R = ["held_min_dev", "duration_h", "depth_frac", "ep_z_first", "pre_z_min_24h", "pre_z_mean_168h", "prior_severe_share", "prior_long_share",
         "prior_max_depth_frac", "hours_since_prior_end", "asset_age_days", "log_prior_episodes", "log_asset_age_days"]
ESC_K = ["episode_id", "landmark", "ts", "severity", "ongoing", "decided_severe", "y_severe", "y_long", "ep_hours_below", "ep_back_in_band",
         "prior_episodes", "prior_severe", "prior_long", "und_below"]


@query("e17_e18_escalation", f"SELECT {', '.join(ESC_K)}, {rounds(ESC_R)} FROM escalation", ["escalation"])
def e17(spark, sf):
    return rounded(T.escalation.build(spark, sf), [*ESC_K, *ESC_R])


@query("e21_severe_hour", "SELECT symbol, t0, severe_ts FROM severe_ts", ["severe_ts"])
def e21(spark, sf):
    return B.severe_hours(T.clean_episodes(spark, sf), T.dev(spark, sf), T.RULES.severe_level)


T.block("waits", """
SELECT symbol, t0, severity, severe_ts, CASE WHEN severe_ts IS NOT NULL THEN greatest((severe_ts - tk) / 3600, 0) END AS wait_h
FROM clean_eps e LEFT JOIN (
  SELECT e.symbol, e.t0, min(h.ts) AS severe_ts FROM clean_eps e JOIN (
    SELECT symbol, ts, lag(ts) OVER w AS pt, greatest(dev_obs, lag(dev_obs) OVER w) AS g, lag(dev_obs) OVER w AS p FROM dev WHERE dev_obs IS NOT NULL
    WINDOW w AS (PARTITION BY symbol ORDER BY ts)) h ON h.symbol = e.symbol AND h.pt >= e.t0 AND h.p IS NOT NULL AND g <= -0.60007
  GROUP BY ALL) USING (symbol, t0)""", ["clean_eps", "dev"])


@query("e22_waits", "SELECT symbol, t0, severity, severe_ts, round(wait_h, 6) AS wait_h FROM waits", ["waits"])
def e22(spark, sf):
    return rounded(B.waits(T.clean_episodes(spark, sf), T.dev(spark, sf), T.RULES.severe_level), ["symbol", "t0", "severity", "severe_ts", "wait_h"])


@query("e22_wait_summary", """
SELECT count(*) AS episodes, count(wait_h) AS reached, round(quantile_cont(wait_h, 0.5), 6) AS median_h,
 round(avg(CAST(coalesce(wait_h, 1e9) <= 6 AS INT)), 6) AS within_6h, round(avg(CAST(coalesce(wait_h, 1e9) <= 24 AS INT)), 6) AS within_24h
FROM waits WHERE severity IN ('major', 'collapse')""", ["waits"])
def e22s(spark, sf):
    w = B.waits(T.clean_episodes(spark, sf), T.dev(spark, sf), T.RULES.severe_level).filter("severity in ('major', 'collapse')")
    out = B.wait_summary(w)
    return rounded(out, out.columns)


# ------------------------------------------------------------------------------------------------ contagion
SEED = ["seed_id", "seed", "seed_t0", "seed_severity", "tau", "cluster", "split"]


@query("e19_seeds", f"SELECT {', '.join(SEED)} FROM seeds", ["seeds"])
def e19(spark, sf):
    return T.seeds.build(spark, sf).select(*SEED)


@query("e19_all_seeds", """
SELECT symbol || '@' || t0 AS seed_id, tk AS tau, CAST(sum(CASE WHEN tk - p <= 259200 THEN 0 ELSE 1 END) OVER (ORDER BY tk, symbol) - 1 AS BIGINT) AS cluster
FROM (SELECT symbol, t0, tk, lag(tk) OVER (ORDER BY tk, symbol) AS p FROM clean_eps)""", ["clean_eps"])
def e19a(spark, sf):
    return B.seeds(T.clean_episodes(spark, sf), T.dev(spark, sf), "all", T.RULES).select("seed_id", "tau", "cluster")


@query("c13_c14_candidates", "SELECT seed_id, tau, cluster, cand, y72, y168 FROM pairs", ["pairs"])
def c13(spark, sf):
    return T.pairs.build(spark, sf).select("seed_id", "tau", "cluster", "cand", "y72", "y168")


@query("c13_known_candidates", """
SELECT seed_id, a.symbol AS cand FROM seeds s, (SELECT DISTINCT symbol FROM dev) a
WHERE a.symbol <> seed AND EXISTS (SELECT 1 FROM dev d WHERE d.symbol = a.symbol AND dev IS NOT NULL AND d.ts BETWEEN tau - 86400 AND tau)
  AND NOT EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.tk <= tau AND e.t1 > tau - 86400)
  AND NOT EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.terminal AND e.tk <= tau)""", ["seeds", "dev", "clean_eps"])
def c13k(spark, sf):
    return B.candidates(T.seeds(spark, sf), T.clean_episodes(spark, sf), T.dev(spark, sf), known=True).select("seed_id", "cand")


T.block("follow", """
SELECT seed_id, cand, tau, (k + 0.5) / (n + 10) AS follow_rate, (ks + 0.5) / (ns + 10) AS codepeg_share FROM (
  SELECT p.seed_id, p.cand, p.tau, count(i.t0) FILTER (i.symbol <> p.cand) AS n, count(i.t0) FILTER (i.symbol <> p.cand AND f) AS k,
    count(i.t0) FILTER (i.symbol = p.seed) AS ns, count(i.t0) FILTER (i.symbol = p.seed AND f) AS ks
  FROM pairs p LEFT JOIN (
    SELECT i.symbol, i.t0, a.symbol AS c, EXISTS (SELECT 1 FROM clean_eps j WHERE j.symbol = a.symbol AND j.t0 > i.t0 AND j.t0 <= i.t0 + 604800) AS f
    FROM clean_eps i, (SELECT DISTINCT symbol FROM dev) a) i ON i.c = p.cand AND i.t0 <= p.tau - 169 * 3600
  GROUP BY ALL)""", ["pairs", "clean_eps", "dev"])


@query("j22_follow_share", "SELECT seed_id, cand, round(follow_rate, 6) AS follow_rate, round(codepeg_share, 6) AS codepeg_share FROM follow", ["follow"])
def j22(spark, sf):
    return rounded(B.follow(T.pairs(spark, sf), T.clean_episodes(spark, sf)), ["seed_id", "cand", "follow_rate", "codepeg_share"])
