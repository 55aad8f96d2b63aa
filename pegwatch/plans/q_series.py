"""Queries on samples, hourly series, deviations and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pegwatch.operators import episodes as E
from pegwatch.operators import series as X
from pegwatch.plans import standins as T
from pegwatch.plans.registry import query
from pegwatch.rules import HOUR


def r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@query("a3_price_scan", """
SELECT sample_id, symbol, ts, CAST(round_even(ts / 3600, 0) AS BIGINT) * 3600 AS hour, price, source FROM scanned
""", ["scanned"])
def a3(spark, sf):
    from pegwatch.functions.scalars import nearest_hour
    return T.scanned(spark, sf).select("sample_id", "symbol", "ts", nearest_hour("ts").alias("hour"), "price", "source")


@query("a4_valid_rates", "SELECT symbol, ts, rate FROM rates WHERE ok = 1 AND rate BETWEEN 0.01 AND 1000", ["rates"])
def a4(spark, sf):
    return X.valid_rates(T.rates(spark, sf), T.RULES)


@query("f4_nearest_sample", "SELECT source, symbol, hour, ts, price, sample_id FROM prices", ["prices"])
def f4(spark, sf):
    return T.prices.build(spark, sf).select("source", "symbol", "hour", "ts", "price", "sample_id")


@query("e1_dense_hours", """
SELECT source, symbol, ts, round(price, 6) AS price
FROM (SELECT source, symbol, unnest(generate_series(min(hour), max(hour), 3600)) AS ts FROM prices GROUP BY source, symbol)
LEFT JOIN (SELECT source, symbol, hour AS ts, price FROM prices) USING (source, symbol, ts)
""", ["prices"])
def e1(spark, sf):
    p = T.prices(spark, sf).select("source", "symbol", F.col("hour").alias("ts"), "price")
    return X.densify(p, ["source", "symbol"]).select("source", "symbol", "ts", r("price"))


@query("e2_bounded_fill", "SELECT source, symbol, ts, obs, round(value, 6) AS value FROM filled", ["filled"])
def e2(spark, sf):
    own = X.own_values(T.prices(spark, sf), T.registry(spark, sf), T.BASE)
    dense = X.densify(own, ["source", "symbol"]).withColumn("obs", F.col("own").isNotNull())
    return X.ffill(dense, "own", 3, ["source", "symbol"], out="value").select("source", "symbol", "ts", "obs", r("value"))


@query("c5_interpolated_ratio", """
SELECT source, symbol, hour, round(base_price, 6) AS base_price, round(price / base_price, 6) AS ratio
FROM interp WHERE base_price IS NOT NULL
""", ["interp"])
def c5(spark, sf):
    p = T.prices(spark, sf)
    eth = p.join(T.registry(spark, sf).filter("peg = 'ETH'").select("symbol"), "symbol", "left_semi")
    return X.interp_ratio(eth, p.filter(F.col("symbol") == T.BASE)).select(
        "source", "symbol", "hour", r("base_price"), r("ratio"))


@query("e4_trailing_median", """
SELECT source, symbol, ts, CASE WHEN count(value) OVER w >= 12 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS trailing
FROM filled
WINDOW w AS (PARTITION BY source, symbol ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)
""", ["filled"])
def e4(spark, sf):
    keys = ["source", "symbol"]
    own = X.own_values(T.prices(spark, sf), T.registry(spark, sf), T.BASE)
    v = X.ffill(X.densify(own, keys), "own", 3, keys, out="value")
    return v.select(*keys, "ts", F.round(X.trailing_median("value", 168, 12, keys), 6).alias("trailing"))


@query("c2_rate_asof", """
SELECT t.symbol, t.ts, CASE WHEN t.ts - r.ts <= 259200 THEN rate END AS rate,
       CASE WHEN t.ts - r.ts <= 259200 THEN r.ts END AS ts_matched
FROM (SELECT DISTINCT symbol, ts FROM filled) t
ASOF LEFT JOIN (SELECT symbol, ts, rate FROM rates WHERE ok = 1 AND rate BETWEEN 0.01 AND 1000) r
  ON r.symbol = t.symbol AND t.ts >= r.ts
""", ["filled", "rates"])
def c2(spark, sf):
    own = X.own_values(T.prices(spark, sf), T.registry(spark, sf), T.BASE)
    left = X.densify(own, ["source", "symbol"]).select("symbol", "ts").distinct()
    return X.asof(left, X.valid_rates(T.rates(spark, sf), T.RULES), ["rate"], ["symbol"], 72 * HOUR)


@query("k2_deviation", """
SELECT source, symbol, kind, ts, obs, round(value, 6) AS value, round(ref, 6) AS ref, round(dev, 6) AS dev FROM dev_all
""", ["dev_all"])
def k2(spark, sf):
    return T.dev_all.build(spark, sf).select("source", "symbol", "kind", "ts", "obs", r("value"), r("ref"), r("dev"))


@query("k1_source_choice", "SELECT symbol, source, ts, round(dev, 6) AS dev FROM dev", ["dev"])
def k1(spark, sf):
    return X.choose_source(T.dev_all(spark, sf), T.SOURCES).select("symbol", "source", "ts", r("dev"))


@query("e3_observed_flag", "SELECT symbol, ts, obs, round(dev_obs, 6) AS dev_obs FROM dev", ["dev"])
def e3(spark, sf):
    return T.dev(spark, sf).select("symbol", "ts", "obs", r("dev_obs"))


EPISODE_SQL = """symbol, t0, t1, confirmed_at, hours_below, round(min_dev, 5) AS min_dev,
 round(held_min_dev, 5) AS held_min_dev, hours_beyond_dead, ongoing"""


@query("e5_episodes", f"SELECT {EPISODE_SQL} FROM detected", ["detected"])
def e5(spark, sf):
    eps = E.detect_with(T.dev.build(spark, sf), T.RULES)
    return eps.select("symbol", "t0", "t1", "confirmed_at", "hours_below", r("min_dev", 5), r("held_min_dev", 5),
                      "hours_beyond_dead", "ongoing")


@query("e6_held_depth", """
SELECT symbol, t0, round(min(greatest(dev_obs, p)) FILTER (p IS NOT NULL), 5) AS held_min_dev, count(*) AS samples
FROM (
  SELECT d.symbol, e.t0, d.ts, dev_obs, lag(dev_obs) OVER (PARTITION BY d.symbol, e.t0 ORDER BY d.ts) AS p
  FROM dev d JOIN detected e ON e.symbol = d.symbol AND d.ts BETWEEN e.t0 AND e.t1 WHERE dev_obs IS NOT NULL
) GROUP BY symbol, t0
""", ["dev", "detected"])
def e6(spark, sf):
    return E.held_depth(T.dev(spark, sf), T.raw_episodes(spark, sf).select("symbol", "t0", "t1")).select("symbol", "t0", r("held_min_dev", 5), "samples")


@query("b12_severity", "SELECT symbol, t0, round(held_min_dev, 5) AS held_min_dev, severity FROM raw_eps", ["raw_eps"])
def b12(spark, sf):
    return T.raw_episodes(spark, sf).select("symbol", "t0", r("held_min_dev", 5), "severity")


@query("b4_known_time", "SELECT symbol, t0, confirmed_at, tk FROM raw_eps", ["raw_eps"])
def b4(spark, sf):
    return T.raw_episodes(spark, sf).select("symbol", "t0", "confirmed_at", "tk")


@query("c8_second_source", """
SELECT e.symbol, e.t0, CASE max_by(hit, rk) WHEN 1 THEN 'yes' WHEN 0 THEN 'no' ELSE '' END AS confirmed_by_second_source
FROM raw_eps e LEFT JOIN (
  SELECT e.symbol, e.t0, CASE d.source WHEN 'main' THEN 1 ELSE 2 END AS rk, max(CASE WHEN dev <= -theta * 0.5 THEN 1 ELSE 0 END) AS hit
  FROM raw_eps e JOIN dev_all d ON d.symbol = e.symbol AND d.ts BETWEEN e.t0 - 3600 AND e.t1 + 3600 AND d.source <> e.source
  WHERE dev IS NOT NULL GROUP BY ALL
) h ON h.symbol = e.symbol AND h.t0 = e.t0
GROUP BY e.symbol, e.t0
""", ["raw_eps", "dev_all"])
def c8(spark, sf):
    every = T.dev_all(spark, sf)
    return E.second_source(T.raw_episodes(spark, sf), every, T.SOURCES, T.RULES).select("symbol", "t0", "confirmed_by_second_source")


QUALITY = ["symbol", "t0", "t1", "hours_below", "suspect", "dropped", "terminal"]


@query("k3_k6_quality", f"SELECT {', '.join(QUALITY)} FROM eps", ["eps"])
def k3(spark, sf):
    return T.episodes.build(spark, sf).select(*QUALITY)


@query("b2_clean_episodes", "SELECT symbol, t0, severity FROM clean_eps", ["clean_eps"])
def b2(spark, sf):
    return T.clean_episodes(spark, sf).select("symbol", "t0", "severity")


T.block("labels", """
SELECT d.symbol, d.ts, d.dev, d.obs, d.theta, d.peg, d.category, CASE WHEN i.symbol IS NOT NULL THEN 1 ELSE 0 END AS in_episode,
""" + ",\n".join(f"""
 CASE WHEN i.symbol IS NOT NULL OR d.dev IS NULL OR m{h}.symbol IS NOT NULL OR coalesce(d.ts >= death, false) THEN NULL
      WHEN a{h}.symbol IS NOT NULL THEN 1 WHEN d.ts > last - {h} * 3600 THEN NULL ELSE 0 END AS y{h}""" for h in (24, 72)) + """
FROM dev d
LEFT JOIN (SELECT symbol, max(ts) AS last FROM dev WHERE dev IS NOT NULL GROUP BY symbol) l USING (symbol)
LEFT JOIN (SELECT symbol, min(death) AS death FROM eps GROUP BY symbol) k USING (symbol)
LEFT JOIN (SELECT DISTINCT d.symbol, d.ts FROM dev d JOIN clean_eps e ON e.symbol = d.symbol AND d.ts BETWEEN t0 AND t1) i
  ON i.symbol = d.symbol AND i.ts = d.ts
""" + "\n".join(f"""
LEFT JOIN (SELECT DISTINCT d.symbol, d.ts FROM dev d JOIN clean_eps e ON e.symbol = d.symbol AND d.ts BETWEEN t0 - {h} * 3600 AND t0 - 3600) a{h}
  ON a{h}.symbol = d.symbol AND a{h}.ts = d.ts
LEFT JOIN (SELECT DISTINCT d.symbol, d.ts FROM dev d JOIN eps e ON e.symbol = d.symbol AND suspect <> '' AND NOT dropped
           AND d.ts BETWEEN t0 - {h} * 3600 AND t1) m{h} ON m{h}.symbol = d.symbol AND m{h}.ts = d.ts""" for h in (24, 72)),
        ["dev", "eps", "clean_eps"])


@query("e7_e8_labels", "SELECT symbol, ts, in_episode, y24, y72 FROM labels", ["labels"])
def e7(spark, sf):
    return T.labels.build(spark, sf).select("symbol", "ts", "in_episode", "y24", "y72")


@query("e7_onset_window", """
SELECT symbol, ts, round(dev, 6) AS dev, CASE WHEN inside THEN 1 ELSE 0 END AS in_episode,
       CASE WHEN inside OR dev IS NULL THEN NULL WHEN ahead THEN 1 WHEN ts > last - 86400 THEN NULL ELSE 0 END AS y
FROM (
  SELECT symbol, ts, dev, max(CASE WHEN dev IS NOT NULL THEN ts END) OVER (PARTITION BY symbol) AS last,
    EXISTS (SELECT 1 FROM raw_eps e WHERE e.symbol = d.symbol AND d.ts BETWEEN e.t0 AND e.t1) AS inside,
    EXISTS (SELECT 1 FROM raw_eps e WHERE e.symbol = d.symbol AND e.t0 > d.ts AND e.t0 <= d.ts + 86400) AS ahead
  FROM dev d)
""", ["dev", "raw_eps"])
def e7w(spark, sf):
    return E.onset_flags(T.dev(spark, sf), T.raw_episodes(spark, sf), 24).select("symbol", "ts", r("dev"), "in_episode", "y")


@query("d9_coverage", """
SELECT symbol, min(ts) AS first_hour, max(ts) AS last_hour, count(*) AS n_hours, round(count(*) / max(n_all), 3) AS coverage,
       round(max(n_filled) / max(n_all), 3) AS coverage_filled,
       round(coalesce(avg(CASE WHEN step < 1e-7 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END), 1), 3) AS flat_share,
       coalesce(avg(CASE WHEN step < 1e-7 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END), 1) >= 0.9 AS derived_suspect,
       round(quantile_cont(dev_obs + 1, 0.5), 4) AS median_value_to_ref
FROM (SELECT symbol, ts, dev_obs, abs(dev_obs - lag(dev_obs) OVER (PARTITION BY symbol ORDER BY ts)) AS step
      FROM dev WHERE dev_obs IS NOT NULL)
JOIN (SELECT symbol, count(*) AS n_all, count(dev) AS n_filled FROM dev GROUP BY symbol) USING (symbol)
GROUP BY symbol
""", ["dev"])
def d9(spark, sf):
    return E.coverage(T.dev(spark, sf), T.RULES)


THETAS_USD, THETAS_ETH, RUNS = (0.60014, 0.70014, 0.80014, 0.85014), (0.70014, 0.80014, 0.85014), (1, 2, 3, 4)


def doubles(values):
    return f"[{', '.join(f'{v}::DOUBLE' for v in values)}]"


T.block("grid_rows", f"""
SELECT symbol, ts, dev_obs AS x, peg = 'USD' AS g_usd, g_run,
       unnest(CASE WHEN peg = 'USD' THEN {doubles(THETAS_USD)} ELSE {doubles(THETAS_ETH)} END) AS g_theta
FROM dev, (SELECT unnest({list(RUNS)}) AS g_run) WHERE dev_obs IS NOT NULL
""", ["dev"])
T.islands("grid_eps", "symbol, g_usd, g_theta, g_run", "grid_rows", "g_theta", "0.90017", "g_run", "6", ["grid_rows"])


@query("d11_sensitivity_grid", f"""
SELECT theta_usd, theta_eth, min_run, count(e.symbol) AS episodes
FROM (SELECT unnest({doubles(THETAS_USD)}) AS theta_usd), (SELECT unnest({doubles(THETAS_ETH)}) AS theta_eth), (SELECT unnest({list(RUNS)}) AS min_run)
LEFT JOIN grid_eps e ON e.g_run = min_run AND e.g_theta = CASE WHEN e.g_usd THEN theta_usd ELSE theta_eth END
GROUP BY ALL
""", ["grid_eps"])
def d11(spark, sf):
    return E.grid(T.dev(spark, sf), T.RULES, THETAS_USD, THETAS_ETH, RUNS)


@query("c10_known_events", """
SELECT v.symbol, v.event_ts,
       EXISTS (SELECT 1 FROM dev d WHERE d.symbol = v.symbol AND d.dev IS NOT NULL AND d.ts BETWEEN event_ts - 259200 AND event_ts + 259200) AS data,
       count(e.t0) AS episodes, round(min(min_dev), 5) AS deepest, min(e.t0) AS first_start
FROM (SELECT symbol, max_by(hour, (price, hour)) AS event_ts FROM prices WHERE source = 'main' GROUP BY symbol) v
LEFT JOIN clean_eps e ON e.symbol = v.symbol AND e.t0 <= event_ts + 259200 AND e.t1 >= event_ts - 259200
GROUP BY v.symbol, v.event_ts
""", ["prices", "clean_eps", "dev"])
def c10(spark, sf):
    events = T.prices(spark, sf).filter("source = 'main'").groupBy("symbol").agg(
        F.max_by("hour", F.struct("price", "hour")).alias("event_ts"))
    return E.known_events(events, T.clean_episodes(spark, sf), T.dev(spark, sf)).select(
        "symbol", "event_ts", "data", "episodes", r("deepest", 5), "first_start")


@query("d8_margins", """
SELECT coalesce(year, 'total') AS year, coalesce(day, 'total') AS day, coalesce(category, 'total') AS category, count(*) AS episodes
FROM (SELECT strftime(to_timestamp(t0) AT TIME ZONE 'UTC', '%Y') AS year, strftime(to_timestamp(t0) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, category FROM clean_eps)
GROUP BY GROUPING SETS ((year, day, category), (year, day), (year, category), (year), (category), ())
""", ["clean_eps"])
def d8(spark, sf):
    return E.year_by_category(T.clean_episodes(spark, sf))


@query("d10_concentration", """
SELECT CAST(sum(n) AS BIGINT) AS top_episodes, round(sum(n) / max(total), 6) AS top_share
FROM (SELECT symbol, count(*) AS n, sum(count(*)) OVER () AS total FROM clean_eps GROUP BY symbol ORDER BY n DESC, symbol LIMIT 5)
""", ["clean_eps"])
def d10(spark, sf):
    return E.concentration(T.clean_episodes(spark, sf)).select("top_episodes", r("top_share"))
