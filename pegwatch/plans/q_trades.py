"""Queries on transfers, trades and the second source, and on scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.operators import crosscheck as C
from pegwatch.operators import trades as D
from pegwatch.plans import standins as T
from pegwatch.plans.q_series import r
from pegwatch.plans.registry import query
from pegwatch.session import shared_folder
from pegwatch.sources import scans, schemas, sinks


@query("d1_first_block", """
SELECT epoch_us(o_orderdate) // 3600000000 * 3600 AS hour, min(o_orderkey) AS block_number FROM orders GROUP BY 1
""")
def d1(spark, sf):
    blocks = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("block_number"), T.seconds("o_orderdate").alias("ts"))
    return D.first_block_per_hour(blocks)


@query("a15_token_dimension", "SELECT address, symbol, role, decimals, peg, missing FROM tokens", ["tokens"])
def a15(spark, sf):
    return T.tokens.build(spark, sf)


@query("a15_checked_tokens", "SELECT address, symbol, role, decimals, peg FROM tokens WHERE NOT missing", ["tokens"])
def a15c(spark, sf):
    """Tokens with decimals pass the assertion; a plan over the others would fail."""
    return D.require_decimals(T.tokens(spark, sf).filter("not missing"))


@query("b1_transfer_filter", """
SELECT address, count(*) AS transfers, round(sum(TRY_CAST(quantity AS DOUBLE)), 2) AS raw FROM transfers
WHERE TRY_CAST(quantity AS DOUBLE) IS NOT NULL AND from_address <> '0x' || repeat('0', 40) GROUP BY address
""", ["transfers"])
def b1(spark, sf):
    rows = D.priced_transfers(T.transfers(spark, sf), T.tokens(spark, sf))
    return rows.groupBy("address").agg(F.count("*").alias("transfers"), F.round(F.sum("amount_raw"), 2).alias("raw"))


@query("d2_pair_trades", """
SELECT block_number, party, ts, symbol, peg, quote, round(asset_amount, 6) AS asset_amount, round(quote_amount, 6) AS quote_amount
FROM matched
""", ["matched"])
def d2(spark, sf):
    return T.swaps(spark, sf).select("block_number", "party", "ts", "symbol", "peg", "quote", r("asset_amount"), r("quote_amount"))


@query("d3_dedupe_trades", """
SELECT block_number, symbol, quote, ts, n_parties, round(asset_amount, 6) AS asset_amount, round(quote_amount, 6) AS quote_amount FROM trades
""", ["trades"])
def d3(spark, sf):
    return T.trades.build(spark, sf).select("block_number", "symbol", "quote", "ts", "n_parties", r("asset_amount"), r("quote_amount"))


@query("d4_hourly_prices", """
SELECT symbol, quote, unit, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:00Z') AS hour, n_trades, n_parties, volume_quote,
       round(vwap, 6) AS vwap, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75 FROM hourly
""", ["hourly"])
def d4(spark, sf):
    return D.hourly_prices(T.trades(spark, sf), T.MINIMUMS).select(
        "symbol", "quote", "unit", "hour", "n_trades", "n_parties", "volume_quote", r("vwap"), r("p25"), r("p50"), r("p75"))


@query("d4_sketch_days", """
SELECT symbol, quote, ts // 86400 * 86400 AS ts, count(*) AS n_trades, true AS inside
FROM trades WHERE quote_amount >= CASE peg WHEN 'USD' THEN 1000 ELSE 0.5 END AND asset_amount > 0 GROUP BY ALL""", ["trades"])
def d4s(spark, sf):
    """Daily quartiles from merged hourly sketches: each lies within two percent of its rank (one row at least) of the day's prices."""
    day = (F.floor(F.col("ts") / 86400) * 86400).cast("bigint")
    trades = T.trades(spark, sf)
    approx = D.merged_quartiles(D.price_sketches(trades, T.MINIMUMS))
    least = F.create_map(*[x for k, v in T.MINIMUMS.items() for x in (F.lit(k), F.lit(float(v)))])
    prices = trades.filter((F.col("quote_amount") >= F.try_element_at(least, F.col("peg"))) & (F.col("asset_amount") > 0)).select(
        "symbol", "quote", day.alias("ts"), (F.col("quote_amount") / F.col("asset_amount")).alias("price"))
    ranks = prices.join(approx, ["symbol", "quote", "ts"]).groupBy("symbol", "quote", "ts").agg(
        F.first("n_trades").alias("n_trades"), *[F.count_if(F.col("price") < F.col(c)).alias(f"{c}_below") for c in ("p25", "p50", "p75")],
        *[F.count_if(F.col("price") <= F.col(c)).alias(f"{c}_upto") for c in ("p25", "p50", "p75")])
    slack = F.greatest(F.lit(1.0), F.col("n_trades") * 0.02)
    inside = F.lit(True)
    for c, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        inside = inside & (F.col(f"{c}_below") - slack <= F.col("n_trades") * p) & (F.col(f"{c}_upto") + slack >= F.col("n_trades") * p)
    return ranks.select("symbol", "quote", "ts", "n_trades", inside.alias("inside"))


@query("d5_collapse_quotes", """
SELECT symbol, ts, round(quantile_cont(p50, 0.5), 6) AS price, round(quantile_cont(p75, 0.5), 6) AS high, min(unit) AS unit,
       CAST(sum(n_trades) AS BIGINT) AS n_trades, count(DISTINCT quote) AS n_quotes, round(sum(volume_quote), 2) AS volume_quote
FROM hourly GROUP BY symbol, ts
""", ["hourly"])
def d5(spark, sf):
    return D.collapse_quotes(D.hourly_prices(T.trades(spark, sf), T.MINIMUMS)).select(
        "symbol", "ts", r("price"), r("high"), "unit", "n_trades", "n_quotes", r("volume_quote", 2))


@query("a6_a11_yearly_tables", """
SELECT year(to_timestamp(ts) AT TIME ZONE 'UTC') AS year, count(*) AS trades, round(sum(quote_amount), 2) AS volume FROM trades GROUP BY 1
""", ["trades"])
def a11(spark, sf):
    path = f"{shared_folder(spark)}/tables/trades-{uuid.uuid4().hex}"
    sinks.write_by_year(T.trades(spark, sf), path)
    return spark.read.parquet(path).groupBy("year").agg(
        F.count("*").alias("trades"), F.round(F.sum("quote_amount"), 2).alias("volume"))


@query("a8_flatten_responses", "SELECT sample_id, symbol AS coin_key, ts, price, confidence FROM samples", ["samples"])
def a8(spark, sf):
    coin = F.struct("confidence", F.array(F.struct(F.col("ts").alias("timestamp"), "price")).alias("prices"))
    landed = T.samples(spark, sf).select("sample_id", F.to_json(F.struct(F.create_map("symbol", coin).alias("coins"))).alias("body"))
    return scans.flatten_prices(landed).select("sample_id", "coin_key", "ts", "price", "confidence")


@query("a2_optional_columns", """
SELECT symbol, hour, ts, price, source, 'USD' AS unit, count(*) AS n FROM prices GROUP BY ALL
""", ["prices"])
def a2(spark, sf):
    main = T.prices(spark, sf).filter("source = 'main'").drop("unit", "confidence", "source")
    alt = T.prices(spark, sf).filter("source = 'alt'").drop("unit", "confidence")
    return scans.price_scan([("main", main), ("other", alt)], 0.9).groupBy(
        "symbol", "hour", "ts", "price", "source", "unit").agg(F.count("*").alias("n"))


@query("a1_csv_round_trip", "SELECT symbol, hour, ts, round(price, 4) AS price FROM prices", ["prices"])
def a1(spark, sf):
    path = f"{shared_folder(spark)}/csv/prices-{uuid.uuid4().hex}"
    sinks.write_csv(T.prices(spark, sf).select("symbol", "hour", "ts", "price"), path)
    return scans.read_csv(spark, path, schemas.PRICES, ["symbol", "hour", "ts", "price"]).select("symbol", "hour", "ts", r("price", 4))


@query("a7_registry_scan", "SELECT symbol, category, peg, kind, round(value, 4) AS value FROM registry WHERE peg = 'USD'", ["registry"])
def a7(spark, sf):
    path = f"{shared_folder(spark)}/json/registry-{uuid.uuid4().hex}"
    T.registry(spark, sf).select(
        "symbol", F.lit("").alias("address"), "category", "peg", (F.col("peg") == "USD").alias("in_scope"),
        F.struct("kind", "value").alias("reference")).write.json(path)
    return scans.registry(spark, path, in_scope_only=True, multi_line=False).select("symbol", "category", "peg", "reference.kind", F.round("reference.value", 4).alias("value"))


@query("b5_round_to_hour", """
SELECT sample_id, CASE WHEN abs(ts - h) <= 1200 THEN h END AS hour
FROM (SELECT sample_id, ts, CAST(round_even(ts / 3600, 0) AS BIGINT) * 3600 AS h FROM samples)
""", ["samples"])
def b5(spark, sf):
    return T.samples(spark, sf).select("sample_id", S.nearest_hour("ts", 1200).alias("hour"))


@query("d24_source_coverage", """
SELECT symbol, count(*) AS n_hours, count(*) FILTER (source <> 'main') AS n_fallback
FROM (SELECT symbol, source, CAST(round_even(ts / 3600, 0) AS BIGINT) * 3600 AS hour, ts, sample_id FROM scanned
      QUALIFY row_number() OVER (PARTITION BY symbol, hour ORDER BY source DESC, abs(ts - hour), ts, sample_id) = 1)
GROUP BY symbol
""", ["scanned"])
def d24(spark, sf):
    from pegwatch.operators.series import pick_samples
    rows = T.scanned(spark, sf).withColumn("key", F.col("source")).withColumn("source", F.lit("any"))
    picked = pick_samples(rows, rank=F.when(F.col("key") == "main", 0).otherwise(1))
    return picked.groupBy("symbol").agg(F.count("*").alias("n_hours"), F.count(F.when(F.col("key") != "main", 1)).alias("n_fallback"))


@query("c5_aligned_ratio", """
SELECT a.source, a.symbol, a.ts, round(a.v / b.v, 6) AS ratio
FROM (SELECT * FROM pfill JOIN registry USING (symbol) WHERE peg = 'ETH') a
JOIN pfill b ON b.source = a.source AND b.ts = a.ts AND b.symbol = 'view_0' WHERE a.v IS NOT NULL AND b.v IS NOT NULL
""", ["pfill", "registry"])
def c5b(spark, sf):
    from pegwatch.operators.series import aligned_ratio
    p = T.prices(spark, sf)
    eth = p.join(T.registry(spark, sf).filter("peg = 'ETH'").select("symbol"), "symbol", "left_semi")
    return aligned_ratio(eth, p.filter(F.col("symbol") == T.BASE), 3).select("source", "symbol", "ts", r("ratio"))


T.block("pfill", """
SELECT source, symbol, ts, last_value(price IGNORE NULLS) OVER (PARTITION BY source, symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v
FROM (SELECT source, symbol, unnest(generate_series(min(hour), max(hour), 3600)) AS ts FROM prices GROUP BY source, symbol)
LEFT JOIN (SELECT source, symbol, hour AS ts, price FROM prices) USING (source, symbol, ts)
""", ["prices"])


# ------------------------------------------------------------------------------------------------ second source
EVIDENCE = (4, 2)
SHIFTS = (-14, -7, 7, 14)


def check_sql(rows: str, keys: str) -> str:
    return f"""
SELECT *, CASE WHEN min_high <= -0.80014 THEN 'confirmed' WHEN min_high <= -0.80014 * 0.5 THEN 'partial'
               WHEN trades >= 4 AND hours >= 2 AND max_abs < 0.80014 * 0.5 THEN 'contradicted' ELSE 'unverified' END AS status
FROM (
  SELECT {keys}, count(mid) AS hours, count(high) AS robust_hours, CAST(coalesce(sum(n), 0) AS BIGINT) AS trades, min(mid) AS min_mid,
         max(mid) AS max_mid, max(abs(mid)) AS max_abs, min(high) AS min_high
  FROM (SELECT *, t0 - 7200 AS w0, least(t1, t0 + 259200) + 7200 AS w1 FROM {rows}) e
  LEFT JOIN second s ON s.symbol = e.symbol AND s.ts BETWEEN w0 AND w1 GROUP BY ALL)"""


T.block("checks", check_sql("clean_eps", "e.symbol, e.category, e.t0, e.t1, e.severity"), ["clean_eps", "second"])


def checks(spark, sf):
    return C.check(T.clean_episodes(spark, sf), T.second(spark, sf).drop("category", "theta"), T.RULES, EVIDENCE)


@query("e4_second_series", "SELECT symbol, ts, n, round(mid, 6) AS mid, round(high, 6) AS high FROM second", ["second"])
def second_series(spark, sf):
    return T.second.build(spark, sf).select("symbol", "ts", "n", r("mid"), r("high"))


@query("c9_d6_check", """
SELECT symbol, t0, hours, robust_hours, trades, round(min_mid, 6) AS min_mid, round(max_mid, 6) AS max_mid, round(min_high, 6) AS min_high, status
FROM checks""", ["checks"])
def c9(spark, sf):
    return checks(spark, sf).select("symbol", "t0", "hours", "robust_hours", "trades", r("min_mid"), r("max_mid"), r("min_high"), "status")


T.block("moved", """
SELECT symbol, category, t0 AS episode_start, shift_days, t0 + shift_days * 86400 AS t0, t1 + shift_days * 86400 AS t1
FROM clean_eps, (SELECT unnest([-14, -7, 7, 14]) AS shift_days)
""", ["clean_eps"])
T.block("placebo", check_sql("""(
  SELECT m.* FROM moved m JOIN (SELECT symbol, min(ts) AS a, max(ts) AS b FROM second GROUP BY symbol) USING (symbol)
  WHERE m.t0 - 7200 >= a AND least(m.t1, m.t0 + 259200) + 7200 <= b AND NOT EXISTS (
    SELECT 1 FROM eps x WHERE x.symbol = m.symbol AND NOT x.dropped AND x.t0 - 86400 <= least(m.t1, m.t0 + 259200) + 7200
      AND x.t1 + 86400 >= m.t0 - 7200))""", "e.symbol, e.category, e.episode_start, e.shift_days"), ["moved", "eps", "second"])


def placebo_checks(spark, sf):
    kept = T.episodes(spark, sf).filter("not dropped")
    return C.placebo(T.clean_episodes(spark, sf), kept, T.second(spark, sf).drop("category", "theta"), T.RULES, SHIFTS, EVIDENCE)


@query("c11_placebo", """
SELECT symbol, episode_start, shift_days, hours, trades, round(min_high, 6) AS min_high, status FROM placebo""", ["placebo"])
def c11(spark, sf):
    return placebo_checks(spark, sf).select("symbol", "episode_start", "shift_days", "hours", "trades", r("min_high"), "status")


T.block("second_known", "SELECT symbol, ts, high AS x FROM second WHERE high IS NOT NULL", ["second"])
T.islands("second_eps", "symbol", "second_known", "0.80014", "0.90017", "2", "6", ["second_known"])


@query("c12_second_only", """
SELECT d.symbol, d.t0, d.t1, round(min(high) FILTER (ts <= d.t1), 6) AS min_high, count(high) FILTER (ts <= d.t1) AS robust_hours,
       CAST(sum(n) FILTER (ts <= d.t1) AS BIGINT) AS trades
FROM second_eps d JOIN second s ON s.symbol = d.symbol AND s.ts BETWEEN d.t0 AND greatest(d.t1, d.t0 + 86400)
WHERE NOT EXISTS (SELECT 1 FROM eps e WHERE e.symbol = d.symbol AND NOT e.dropped AND e.t0 - 86400 <= d.t0 AND e.t1 + 86400 >= d.t0)
GROUP BY d.symbol, d.t0, d.t1 HAVING count(*) FILTER (ts <= d.t0 + 86400 AND high <= -0.80014) >= 1
""", ["second_eps", "second", "eps"])
def c12(spark, sf):
    return C.second_only(T.second(spark, sf).drop("category"), T.episodes(spark, sf).filter("not dropped"), T.RULES, 1).select(
        "symbol", "t0", "t1", r("min_high"), "robust_hours", "trades")


@query("c10_second_source_events", """
SELECT v.symbol, v.event_ts, count(mid) AS hours, round(min(mid), 6) AS min_mid, round(min(high), 6) AS min_high,
       coalesce(bool_or(high <= -0.80014), false) AS beyond_threshold
FROM (SELECT symbol, max_by(hour, (price, hour)) AS event_ts FROM prices WHERE source = 'main' GROUP BY symbol) v
LEFT JOIN second s ON s.symbol = v.symbol AND s.ts BETWEEN event_ts - 259200 AND event_ts + 259200 GROUP BY v.symbol, v.event_ts
""", ["prices", "second"])
def c10b(spark, sf):
    events = T.prices(spark, sf).filter("source = 'main'").groupBy("symbol").agg(
        F.max_by("hour", F.struct("price", "hour")).alias("event_ts"))
    return C.known_events(events, T.second(spark, sf)).select("symbol", "event_ts", "hours", r("min_mid"), r("min_high"), "beyond_threshold")


@query("d7_status_table", """
SELECT category, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'partial') AS "partial",
       count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'unverified') AS unverified, count(*) AS episodes,
       round(count(*) FILTER (status = 'confirmed') / nullif(count(*) FILTER (status <> 'unverified'), 0), 2) AS confirmed_of_checked
FROM checks GROUP BY category""", ["checks"])
def d7(spark, sf):
    return C.status_table(checks(spark, sf), "category")


@query("d21_exclusion_list", "SELECT symbol, t0 AS start, status FROM checks WHERE status NOT IN ('confirmed', 'partial')", ["checks"])
def d21(spark, sf):
    return C.exclusions(checks(spark, sf))


@query("d25_status_shares", """
SELECT severity, scope, count(*) AS windows, """ + ", ".join(
    f"""round(count(*) FILTER (status = '{s}') / count(*), 6) AS "{s}" """ for s in ("confirmed", "partial", "contradicted", "unverified")) + """
FROM checks, (VALUES ('all'), ('robust')) v(scope) WHERE scope = 'all' OR robust_hours > 0 GROUP BY severity, scope""", ["checks"])
def d25(spark, sf):
    out = C.status_shares(checks(spark, sf), "severity")
    return out.select("severity", "scope", "windows", *[r(s) for s in C.STATUSES])


@query("a9_exclusion_flags", "SELECT symbol, t0, t0 IN (SELECT x.t0 FROM exclusions x WHERE x.symbol = raw_eps.symbol) AS excluded FROM raw_eps",
       ["raw_eps", "exclusions"])
def a9(spark, sf):
    raw = T.raw_episodes(spark, sf)
    listed = T.exclusions(raw).select("symbol", F.col("start").alias("t0"), F.lit(True).alias("_x"))
    return raw.join(listed, ["symbol", "t0"], "left").select("symbol", "t0", F.coalesce("_x", F.lit(False)).alias("excluded"))


@query("a13_keyed_upsert", """
SELECT symbol, status, CAST(n AS BIGINT) AS n FROM (
  SELECT symbol, 'old' AS status, count(*) AS n FROM raw_eps WHERE symbol NOT IN (SELECT symbol FROM checks) GROUP BY symbol
  UNION ALL SELECT symbol, status, count(*) FROM checks GROUP BY symbol, status)""", ["raw_eps", "checks"])
def a13(spark, sf):
    old = T.raw_episodes(spark, sf).groupBy("symbol").agg(F.lit("old").alias("status"), F.count("*").alias("n"))
    new = checks(spark, sf).groupBy("symbol", "status").agg(F.count("*").alias("n"))
    return sinks.upsert(old, new, ["symbol"])


@query("a13_stored_upsert", """
SELECT symbol, status, CAST(n AS BIGINT) AS n FROM (
  SELECT symbol, 'old' AS status, count(*) AS n FROM raw_eps WHERE symbol NOT IN (SELECT symbol FROM checks) GROUP BY symbol
  UNION ALL SELECT symbol, status, count(*) FROM checks GROUP BY symbol, status)""", ["raw_eps", "checks"])
def a13s(spark, sf):
    """The same upsert through the stored table, the second write twice."""
    path = f"{shared_folder(spark)}/tables/results-{uuid.uuid4().hex}"
    shape = schemas.schema(symbol="string", status="string", n="bigint")
    sinks.upsert_stored(T.raw_episodes(spark, sf).groupBy("symbol").agg(F.lit("old").alias("status"), F.count("*").alias("n")), path, ["symbol"], shape)
    for _ in range(2):
        sinks.upsert_stored(checks(spark, sf).groupBy("symbol", "status").agg(F.count("*").alias("n")), path, ["symbol"], shape)
    return sinks.read_stored(spark, path, shape).select("symbol", "status", "n")


@query("a3_a6_price_files", """
SELECT source, symbol, count(*) AS n, round(sum(price), 4) AS total FROM prices WHERE year(to_timestamp(ts)) = 2024 GROUP BY ALL""", ["prices"])
def a3f(spark, sf):
    """One reader over the files of all sources, the source from the file's folder, only the folders of a year."""
    base = f"{shared_folder(spark)}/tables/sources-{uuid.uuid4().hex}"
    p = T.prices(spark, sf).select("symbol", "hour", "ts", "price", "source").withColumn("year", F.year(F.timestamp_seconds("ts")))
    names = sorted(r[0] for r in p.select("source").distinct().collect())  # a handful of sources
    for name in names:
        p.filter(F.col("source") == name).drop("source").write.partitionBy("year").parquet(f"{base}/{name}")
    rows = scans.price_files(spark, [f"{base}/{n}" for n in names], 0.0, first_year=2024, last_year=2024)
    return rows.groupBy("source", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("a14_markdown_report", """
SELECT -2 AS sort_key, '| category | confirmed |' AS line UNION ALL SELECT -1, '|---|---|'
UNION ALL SELECT 0, '| ' || category || ' | ' || count(*) FILTER (status = 'confirmed') || ' |' FROM checks GROUP BY category""", ["checks"])
def a14(spark, sf):
    return sinks.markdown_rows(C.status_table(checks(spark, sf), "category").select("category", "confirmed"), ["category"])


@query("k7_report_numbers", """
SELECT count(*) AS episodes, count(*) FILTER (suspect <> '') AS flagged, count(*) FILTER (dropped) AS dropped,
       count(*) FILTER (suspect = '' AND NOT dropped AND t0 <= 1705276800) AS train,
       count(*) FILTER (suspect = '' AND NOT dropped AND t0 > 1705276800 AND t0 <= 1705881600) AS valid,
       count(*) FILTER (suspect = '' AND NOT dropped AND t0 > 1705881600) AS test,
       count(*) FILTER (suspect = '' AND NOT dropped) >= 50 AS enough FROM eps""", ["eps"])
def k7(spark, sf):
    from pegwatch.operators.episodes import report_numbers
    return report_numbers(T.episodes(spark, sf), T.RULES, 50)
