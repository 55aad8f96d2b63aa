"""The driver's tables seen as price samples, transfers, lending markets, vaults and pools.

Every stand-in reads whole tables and adds columns; nothing is sampled or cut. The DuckDB blocks next to each
DataFrame say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pegwatch.operators import episodes as E
from pegwatch.operators import series as X
from pegwatch.plans.registry import block
from pegwatch.rules import DAY, HOUR, Rules
from pegwatch.session import staged

# The test prices are pure noise, so the thresholds are wide. They are not round numbers: no ratio of two-decimal
# prices can sit exactly on one of them.
RULES = Rules(
    theta_usd=0.80014, theta_eth=0.80014, min_run=2, severe=0.90017, band_frac=0.5, recovery=6, gap_fill=3,
    rate_fill_hours=72, trailing_hours=168, trailing_min=12, horizons=(24, 72),
    tiers=((0.5003, "minor"), (0.8003, "major"), (1.0, "collapse")), snapback_dev=-0.97003, snapback_hours=2,
    cluster_assets=3, dead_dev=-0.85007, dead_hours=14, rate_low=0.01, rate_high=1000.0,
    train_end=1705276800, valid_end=1705881600, severe_level=0.60007,
)
BASE = "view_0"
SOURCES = ("main", "alt")
STEP = 30 * DAY


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


# ------------------------------------------------------------------------------------------------ price samples
def samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"),
        F.concat_ws("_", "event_type", (F.col("user_id") % 6).cast("string")).alias("symbol"),
        seconds("ts").alias("ts"), F.col("value").alias("price"),
        F.when(k < 70, "main").otherwise("alt").alias("source"),
        F.when(k.between(35, 69), 1 - (k - 35) / F.lit(300.0)).alias("confidence"), k.alias("k"),
    )


block("samples", """
SELECT event_id AS sample_id, event_type || '_' || (user_id % 6) AS symbol, epoch_us(ts) // 1000000 AS ts,
       value AS price, CASE WHEN k < 70 THEN 'main' ELSE 'alt' END AS source,
       CASE WHEN k BETWEEN 35 AND 69 THEN 1 - (k - 35) / CAST(300 AS DOUBLE) END AS confidence, k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")


@staged
def registry(spark: SparkSession, sf: str) -> DataFrame:
    """One row per asset; kind and peg follow from the number in its name."""
    n = F.element_at(F.split("symbol", "_"), -1).cast("int")
    return samples(spark, sf).select("symbol").distinct().select(
        "symbol", F.element_at(F.split("symbol", "_"), 1).alias("category"),
        F.when(n >= 4, "ETH").otherwise("USD").alias("peg"),
        F.when(n == 2, "fixed").when(n == 3, "rate").when(n == 5, "eth_parity").otherwise("trailing_median").alias("kind"),
        F.when(n == 2, F.lit(35.17)).alias("value"),
    )


block("registry", """
SELECT symbol, split_part(symbol, '_', 1) AS category, CASE WHEN n >= 4 THEN 'ETH' ELSE 'USD' END AS peg,
       CASE n WHEN 2 THEN 'fixed' WHEN 3 THEN 'rate' WHEN 5 THEN 'eth_parity' ELSE 'trailing_median' END AS kind,
       CASE WHEN n = 2 THEN CAST(35.17 AS DOUBLE) END AS value
FROM (SELECT DISTINCT symbol, CAST(split_part(symbol, '_', 2) AS INT) AS n FROM samples)
""", ["samples"])


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that pass the confidence rule; a missing confidence passes."""
    return samples(spark, sf).filter(F.coalesce("confidence", F.lit(1.0)) >= RULES.min_confidence)


block("scanned", "SELECT * FROM samples WHERE coalesce(confidence, 1.0) >= 0.9", ["samples"])


@staged
def prices(spark: SparkSession, sf: str) -> DataFrame:
    return X.pick_samples(scanned(spark, sf)).withColumn("unit", F.lit("USD"))


block("prices", """
SELECT source, symbol, hour, ts, price, sample_id, confidence
FROM (SELECT *, CAST(round_even(ts / 3600, 0) AS BIGINT) * 3600 AS hour FROM scanned)
QUALIFY row_number() OVER (PARTITION BY source, symbol, hour ORDER BY abs(ts - hour), ts, sample_id) = 1
""", ["scanned"])


@staged
def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean price per asset, readable from the end of the day; readings of thin days count as failed."""
    day = (F.floor(F.col("ts") / DAY) * DAY).cast("bigint")
    return scanned(spark, sf).groupBy("symbol", day.alias("day")).agg(
        F.round(F.avg("price"), 6).alias("rate"), F.count("*").alias("n"),
    ).select("symbol", (F.col("day") + DAY).alias("ts"), "rate", F.when(F.col("n") >= 3, 1).otherwise(0).alias("ok"))


block("rates", """
SELECT symbol, (ts // 86400 + 1) * 86400 AS ts, round(avg(price), 6) AS rate,
       CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS ok
FROM scanned GROUP BY symbol, ts // 86400
""", ["scanned"])


# ------------------------------------------------------------------------------------------------ deviations
@staged
def dev_all(spark: SparkSession, sf: str) -> DataFrame:
    return X.deviation(prices(spark, sf), rates(spark, sf), registry(spark, sf), RULES, BASE)


@staged
def dev(spark: SparkSession, sf: str) -> DataFrame:
    return X.observed_only(X.choose_source(dev_all.build(spark, sf), SOURCES))


block("interp", """
SELECT a.source, a.symbol, a.hour, a.ts, a.price,
       CASE WHEN r.ts = a.ts THEN r.price
            WHEN r.ts - a.ts <= 7200 AND a.ts - l.ts <= 7200
            THEN l.price + ((a.ts - l.ts) / (r.ts - l.ts)) * (r.price - l.price) END AS base_price
FROM (SELECT p.* FROM prices p JOIN registry USING (symbol) WHERE peg = 'ETH') a
ASOF LEFT JOIN (SELECT source, ts, price FROM prices WHERE symbol = 'view_0') r ON r.source = a.source AND a.ts <= r.ts
ASOF LEFT JOIN (SELECT source, ts, price FROM prices WHERE symbol = 'view_0') l ON l.source = a.source AND a.ts > l.ts
""", ["prices", "registry"])

block("own", """
SELECT source, symbol, hour AS ts, price AS own FROM prices JOIN registry USING (symbol) WHERE peg = 'USD'
UNION ALL
SELECT source, symbol, hour, price / base_price FROM interp WHERE base_price IS NOT NULL
""", ["interp"])

block("filled", """
SELECT source, symbol, ts, own IS NOT NULL AS obs,
       last_value(own IGNORE NULLS) OVER (PARTITION BY source, symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value
FROM (SELECT source, symbol, unnest(generate_series(min(ts), max(ts), 3600)) AS ts FROM own GROUP BY source, symbol)
LEFT JOIN own USING (source, symbol, ts)
""", ["own"])

block("dev_all", """
SELECT source, symbol, category, peg, kind, ts, value, ref, obs, value / ref - 1 AS dev, CAST(0.80014 AS DOUBLE) AS theta
FROM (
  SELECT t.*, CASE kind WHEN 'fixed' THEN fixed_value WHEN 'eth_parity' THEN 1
                        WHEN 'rate' THEN coalesce(CASE WHEN t.ts - r.ts <= 259200 THEN rate END, trail)
                        ELSE trail END AS ref
  FROM (
    SELECT f.*, category, peg, kind, g.value AS fixed_value,
           CASE WHEN count(f.value) OVER w >= 12 THEN quantile_cont(f.value, 0.5) OVER w END AS trail
    FROM filled f JOIN registry g USING (symbol)
    WINDOW w AS (PARTITION BY source, symbol ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)
  ) t
  ASOF LEFT JOIN (SELECT symbol, ts, rate FROM rates WHERE ok = 1 AND rate BETWEEN 0.01 AND 1000) r
    ON r.symbol = t.symbol AND t.ts >= r.ts
)
""", ["filled", "registry", "rates"])

block("dev", """
SELECT *, CASE WHEN obs THEN dev END AS dev_obs
FROM (SELECT *, CASE source WHEN 'main' THEN 1 ELSE 2 END AS rk FROM dev_all)
QUALIFY rk = min(CASE WHEN dev IS NOT NULL THEN rk END) OVER (PARTITION BY symbol)
""", ["dev_all"])


# ------------------------------------------------------------------------------------------------ episodes
def islands(name: str, keys: str, source: str, theta: str, severe: str, min_run: str, recovery: str,
            needs: list[str]) -> None:
    """Registers the SQL form of episode detection over ``source`` (columns: keys, ts, x)."""
    block(name + "_rows", f"""
SELECT *, sum(CASE WHEN bad AND (prev_bad IS NULL OR rn - prev_bad > {recovery}) THEN 1 ELSE 0 END)
         OVER (PARTITION BY {keys} ORDER BY ts) AS seg
FROM (
  SELECT *, rn - coalesce(max(CASE WHEN NOT hit THEN rn END) OVER w, 0) AS run_len,
         max(CASE WHEN bad THEN rn END) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_bad,
         max(CASE WHEN hit AND NOT coalesce(prev_hit, false) THEN ts END) OVER w AS run_start
  FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS rn, x <= -({theta}) AS hit, x <= -({theta}) * 0.5 AS bad,
           lag(x <= -({theta})) OVER (PARTITION BY {keys} ORDER BY ts) AS prev_hit,
           lag(x) OVER (PARTITION BY {keys} ORDER BY ts) AS prev, lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) AS prev_ts
    FROM {source}
  ) WINDOW w AS (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
""", needs)
    block(name, f"""
SELECT {keys}, min(start) AS t0, min(fin) AS t1, min(conf) AS confirmed_at,
       count(*) FILTER (ts BETWEEN start AND fin AND hit) AS hours_below,
       min(x) FILTER (ts >= conf) AS min_dev,
       min(greatest(x, prev)) FILTER (ts BETWEEN start AND fin AND prev_ts >= start) AS held_min_dev,
       count(*) FILTER (ts BETWEEN start AND fin AND x <= -0.85007) AS hours_beyond_dead,
       max(rn) - max(rn) FILTER (bad) < {recovery.replace('g_rec', 'max(g_rec)')} AS ongoing
FROM (
  SELECT *, min(CASE WHEN trig THEN ts END) OVER s AS conf, min(CASE WHEN trig THEN run_start END) OVER s AS start,
         max(CASE WHEN bad THEN ts END) OVER s AS fin
  FROM (SELECT *, hit AND (run_len >= {min_run} OR x <= -({severe})) AS trig FROM {name}_rows WHERE seg > 0)
  WINDOW s AS (PARTITION BY {keys}, seg)
) WHERE conf IS NOT NULL
GROUP BY {keys}, seg
""", [name + "_rows"])


block("known", "SELECT symbol, ts, dev_obs AS x FROM dev WHERE dev_obs IS NOT NULL", ["dev"])
islands("detected", "symbol", "known", "0.80014", "0.90017", "2", "6", ["known"])

block("raw_eps", """
SELECT d.*, category, peg, source,
       CASE WHEN held_min_dev IS NULL OR abs(held_min_dev) < 0.5003 THEN 'minor'
            WHEN abs(held_min_dev) < 0.8003 THEN 'major' ELSE 'collapse' END AS severity,
       greatest(t0 + 3600, coalesce(confirmed_at, t0)) AS tk
FROM detected d JOIN (SELECT symbol, min(category) AS category, min(peg) AS peg, min(source) AS source FROM dev GROUP BY symbol)
  USING (symbol)
""", ["detected", "dev"])

block("eps", """
SELECT *, coalesce(t0 > death, false) AS dropped, coalesce(t0 = death, false) AS terminal
FROM (
  SELECT *, min(CASE WHEN suspect = '' AND hours_beyond_dead >= 14 THEN t0 END) OVER (PARTITION BY symbol) AS death
  FROM (
    SELECT r.*, CASE WHEN round(r.min_dev, 5) <= -0.97003 AND NOT ongoing AND (r.t1 - r.t0) / 3600 + 1 <= 2 THEN 'snapback'
                     WHEN hours_below = 1 AND singles >= 3 THEN 'same_hour_cluster'
                     WHEN x.t0 IS NOT NULL THEN 'excluded' ELSE '' END AS suspect
    FROM raw_eps r
    LEFT JOIN (SELECT t0, count(*) AS singles FROM raw_eps WHERE hours_below = 1 GROUP BY t0) s ON s.t0 = r.t0
    LEFT JOIN exclusions x ON x.symbol = r.symbol AND x.t0 = r.t0
  )
)
""", ["raw_eps", "exclusions"])

block("exclusions", """
SELECT symbol, t0 FROM raw_eps
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t0 DESC) = 1 AND min_dev > -0.86
""", ["raw_eps"])

block("clean_eps", "SELECT * FROM eps WHERE suspect = '' AND NOT dropped", ["eps"])


@staged
def raw_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return E.raw_episodes(dev(spark, sf), RULES)


def exclusions(raw: DataFrame) -> DataFrame:
    """The last episode of an asset, where it was shallow, stands for one a second source contradicted."""
    return raw.groupBy("symbol").agg(F.max_by(F.struct("t0", "min_dev"), "t0").alias("e")).filter(
        "e.min_dev > -0.86").select("symbol", F.col("e.t0").alias("start"))


@staged
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_episodes(spark, sf)
    return E.quality(raw, RULES, exclusions(raw))


def clean_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return E.clean(episodes(spark, sf))


@staged
def labels(spark: SparkSession, sf: str) -> DataFrame:
    return E.labels(dev(spark, sf), episodes(spark, sf), RULES)


# ------------------------------------------------------------------------------------------------ transfers
FLOORS = {"USD": 1.0, "ETH": 0.0005}
MINIMUMS = {"USD": 1000.0, "ETH": 0.5}


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Goods against money per order line: supplier and customer each pay one token and receive another. Dealt by block (the order)."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    ).drop("l_partkey").select("l_orderkey", "l_suppkey", "p_brand", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate").repartition("l_orderkey").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    supplier, customer = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("c"), F.col("o_custkey"))
    free = (F.col("l_tax") == 0) & (F.col("l_discount") == 0)
    goods = F.struct(
        F.lower("p_brand").alias("address"), supplier.alias("from_address"), customer.alias("to_address"),
        F.when(free, "n/a").otherwise(F.round(F.col("l_quantity") * 1009).cast("bigint").cast("string")).alias("quantity"))
    money = F.struct(
        F.when(F.col("l_linestatus") == "O", "usd").otherwise("eur").alias("address"),
        F.when(F.col("l_tax") == 0.08, F.lit("0x" + "0" * 40)).otherwise(customer).alias("from_address"),
        supplier.alias("to_address"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string").alias("quantity"))
    ts = seconds("l_shipdate") + (F.col("l_orderkey") % 24) * HOUR
    return lines.select(F.col("l_orderkey").alias("block_number"), F.lit(0).cast("bigint").alias("transaction_index"),
                        ts.alias("ts"), F.explode(F.array(goods, money)).alias("leg")).select(
        "block_number", "transaction_index", "ts", "leg.*")


block("transfers", """
SELECT block_number, 0 AS transaction_index, ts, leg.address AS address, leg.f AS from_address, leg.t AS to_address, leg.q AS quantity
FROM (
  SELECT l_orderkey AS block_number, epoch_us(l_shipdate) // 1000000 + (l_orderkey % 24) * 3600 AS ts,
    unnest([
      {'address': lower(p_brand), 'f': 's' || l_suppkey, 't': 'c' || o_custkey,
       'q': CASE WHEN l_tax = 0 AND l_discount = 0 THEN 'n/a' ELSE CAST(CAST(round(l_quantity * 1009) AS BIGINT) AS VARCHAR) END},
      {'address': CASE WHEN l_linestatus = 'O' THEN 'usd' ELSE 'eur' END,
       'f': CASE WHEN l_tax = 0.08 THEN '0x' || repeat('0', 40) ELSE 'c' || o_custkey END, 't': 's' || l_suppkey,
       'q': CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)}]) AS leg
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
""")


@staged
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.trades import token_dimension
    brands = table(spark, sf, "part").select("p_brand").distinct()
    n = F.regexp_extract("p_brand", "(\\d+)$", 1).cast("int")
    assets = brands.select(F.lower("p_brand").alias("address"), F.col("p_brand").alias("symbol"),
                           F.when(n > 20, "ETH").otherwise("USD").alias("peg"))
    quotes = spark.createDataFrame([("usd", "USD", "USD"), ("eur", "EUR", "USD")], "address string, symbol string, peg string")
    onchain = brands.filter(n <= 10).select(F.lower("p_brand").alias("address"), F.lit(3).alias("decimals")).unionByName(
        quotes.select("address", F.lit(2).alias("decimals")))
    meta = brands.filter(n <= 24).select(F.lower("p_brand").alias("address"), F.lit(3).alias("decimals"))
    return token_dimension(assets, quotes, onchain, meta)


block("tokens", """
SELECT lower(p_brand) AS address, p_brand AS symbol, 'asset' AS role, CASE WHEN n <= 24 THEN 3 END AS decimals,
       CASE WHEN n > 20 THEN 'ETH' ELSE 'USD' END AS peg, n > 24 AS missing
FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS n FROM part)
UNION ALL SELECT * FROM (VALUES ('usd', 'USD', 'quote', 2, 'USD', false), ('eur', 'EUR', 'quote', 2, 'USD', false))
""")

block("moves", """
SELECT block_number, transaction_index, ts, address, from_address, to_address, TRY_CAST(quantity AS DOUBLE) AS amount
FROM transfers SEMI JOIN tokens USING (address)
WHERE TRY_CAST(quantity AS DOUBLE) IS NOT NULL AND from_address <> '0x' || repeat('0', 40) AND to_address <> '0x' || repeat('0', 40)
""", ["transfers", "tokens"])

# what a party got and paid in a transaction, where that is one token each
for _side, _party in (("got", "to_address"), ("paid", "from_address")):
    block(f"only_{_side}", f"""
SELECT block_number, transaction_index, {_party} AS party, any_value(address) AS address, sum(amount) AS amount, min(ts) AS ts
FROM moves GROUP BY block_number, transaction_index, {_party} HAVING min(address) = max(address)
""", ["moves"])

block("swaps", """
SELECT block_number, transaction_index, least(g.ts, p.ts) AS ts, party, a.symbol, a.peg, q.symbol AS quote, q.peg AS quote_peg,
       CASE a.address WHEN g.address THEN g.amount ELSE p.amount END / pow(10, a.decimals) AS asset_amount,
       CASE q.address WHEN g.address THEN g.amount ELSE p.amount END / pow(10, q.decimals) AS quote_amount
FROM only_got g JOIN only_paid p USING (block_number, transaction_index, party)
JOIN tokens a ON a.role = 'asset' AND a.address IN (g.address, p.address)
JOIN tokens q ON q.role = 'quote' AND q.address IN (g.address, p.address)
WHERE least(g.amount, p.amount) > 0
""", ["only_got", "only_paid", "tokens"])

block("matched", """
SELECT s.* FROM swaps s JOIN (VALUES ('USD', 1.0), ('ETH', 0.0005)) f(unit, least_amount) ON unit = peg AND unit = quote_peg AND quote_amount >= least_amount
""", ["swaps"])

block("trades", """
SELECT block_number, transaction_index, symbol, peg, quote, min(ts) AS ts, max(asset_amount) AS asset_amount, max(quote_amount) AS quote_amount,
       count(DISTINCT party) AS n_parties
FROM matched GROUP BY block_number, transaction_index, symbol, peg, quote
""", ["matched"])

block("hourly", """
SELECT symbol, quote, ts // 3600 * 3600 AS ts, any_value(peg) AS unit, count(*) AS n_trades, CAST(sum(n_parties) AS BIGINT) AS n_parties,
       round(sum(quote_amount), 2) AS volume_quote, sum(quote_amount) / sum(asset_amount) AS vwap,
       quantile_cont(quote_amount / asset_amount, 0.25) AS p25, quantile_cont(quote_amount / asset_amount, 0.5) AS p50,
       quantile_cont(quote_amount / asset_amount, 0.75) AS p75
FROM trades WHERE quote_amount >= CASE peg WHEN 'USD' THEN 1000 ELSE 0.5 END AND asset_amount > 0
GROUP BY symbol, quote, ts // 3600
""", ["trades"])


def swaps(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.trades import pair_trades, priced_transfers
    t = tokens(spark, sf)
    return pair_trades(priced_transfers(transfers(spark, sf), t), t, FLOORS)


@staged
def trades(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.trades import dedupe_trades
    return dedupe_trades(swaps(spark, sf))


# ------------------------------------------------------------------------------------------------ second source
@staged
def second(spark: SparkSession, sf: str) -> DataFrame:
    """The alternative samples as a trade source: hourly median and upper quartile, both as deviations."""
    from pegwatch.functions.ranks import exact_quantiles
    from pegwatch.operators.trades import hour_of
    alt = samples(spark, sf).filter("source = 'alt'").withColumn("hour", hour_of())
    q = exact_quantiles(alt, "price", {"mid": 0.5, "high": 0.75}, ["symbol", "hour"])
    n = alt.groupBy("symbol", "hour").agg(F.count("*").alias("n"))
    out = None
    for c in ("mid", "high"):
        p = q.select(F.lit("alt").alias("source"), "symbol", "hour", F.col("hour").alias("ts"), F.col(c).alias("price"),
                     F.lit("ETH").alias("unit"))
        d = X.deviation(p, rates(spark, sf), registry(spark, sf), RULES, BASE).filter("obs and dev is not null").select(
            "symbol", "category", "theta", "ts", F.col("dev").alias(c))
        out = d if out is None else out.join(d.drop("category", "theta"), ["symbol", "ts"], "left")
    return out.join(n.withColumnRenamed("hour", "ts"), ["symbol", "ts"])


block("alt_hours", """
SELECT symbol, ts // 3600 * 3600 AS ts, quantile_cont(price, 0.5) AS mid, quantile_cont(price, 0.75) AS high, count(*) AS n
FROM samples WHERE source = 'alt' GROUP BY symbol, ts // 3600
""", ["samples"])
for _c in ("mid", "high"):
    block(f"second_{_c}", f"""
SELECT t.symbol, t.ts, category, v / CASE kind WHEN 'fixed' THEN fv WHEN 'eth_parity' THEN 1
         WHEN 'rate' THEN coalesce(CASE WHEN t.ts - r.ts <= 259200 THEN rate END, trail) ELSE trail END - 1 AS dev
FROM (
  SELECT f.*, category, kind, g.value AS fv, CASE WHEN count(v) OVER w >= 12 THEN quantile_cont(v, 0.5) OVER w END AS trail
  FROM (SELECT symbol, ts, {_c} IS NOT NULL AS obs,
               last_value({_c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v
        FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), 3600)) AS ts FROM alt_hours GROUP BY symbol)
        LEFT JOIN alt_hours USING (symbol, ts)) f JOIN registry g USING (symbol)
  WINDOW w AS (PARTITION BY f.symbol ORDER BY f.ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)
) t
ASOF LEFT JOIN (SELECT symbol, ts, rate FROM rates WHERE ok = 1 AND rate BETWEEN 0.01 AND 1000) r ON r.symbol = t.symbol AND t.ts >= r.ts
WHERE obs
""", ["alt_hours", "registry", "rates"])
block("second", """
SELECT m.symbol, m.category, CAST(0.80014 AS DOUBLE) AS theta, m.ts, m.dev AS mid, h.dev AS high, n
FROM second_mid m LEFT JOIN second_high h USING (symbol, ts) JOIN alt_hours a USING (symbol, ts) WHERE m.dev IS NOT NULL
""", ["second_mid", "second_high", "alt_hours"])


# ------------------------------------------------------------------------------------------------ features
# The exposure measures by kind.
EXPO_USD = ("mm_collateral_usd", "mm_borrow_against_usd", "mm_pegged_loop_usd", "mm_supply_usd", "mm_borrowed_usd", "vault_exposure_usd", "family_collateral_usd",
            "family_vault_exposure_usd", "family_borrow_against_usd", "aave_supply_usd", "aave_collateral_usd", "aave_borrow_usd")
EXPO_RAW = ("mm_n_markets", "mm_lltv_wavg", "mm_blind_oracle_share", "mm_custom_oracle_share", "vault_n", "aave_ltv_max", "aave_frozen", "aave_supply_cap_use", "aave_oracle_gap")
EXPO_CHANGE = ("mm_borrow_against_usd", "mm_supply_usd", "vault_exposure_usd", "family_collateral_usd", "family_borrow_against_usd", "aave_supply_usd", "aave_borrow_usd")
# The stand-in's measures as shares of the value sampled in the day before: "total" may be unknown, "own" is then 0.
EXPO_SQL = {
    "mm_collateral_usd": "total", "mm_borrow_against_usd": "total * 0.6", "mm_pegged_loop_usd": "total * 0.2", "mm_supply_usd": "CASE WHEN own > 20000 THEN total * 0.1 END",
    "mm_borrowed_usd": "total * 0.05", "vault_exposure_usd": "own * 0.3", "family_collateral_usd": "own + 2500", "family_vault_exposure_usd": "own * 0.4 + 100",
    "family_borrow_against_usd": "own * 0.7", "aave_supply_usd": "CAST(0 AS DOUBLE)", "aave_collateral_usd": "total * 0.15", "aave_borrow_usd": "own * 0.08",
    "mm_n_markets": "floor(own / 5000)", "mm_lltv_wavg": "CASE WHEN own > 0 THEN 0.5 + own / (own + 100000) * 0.4 END", "mm_blind_oracle_share": "total / (total + 30000)",
    "mm_custom_oracle_share": "total / (total + 60000)", "vault_n": "floor(own / 9000)", "aave_ltv_max": "CASE WHEN own > 15000 THEN 0.75 ELSE 0.0 END",
    "aave_frozen": "CASE WHEN own > 40000 THEN 1.0 ELSE 0.0 END", "aave_supply_cap_use": "least(own / 50000, 1.0)", "aave_oracle_gap": "total / 1000000"}
CATEGORIES = ("click", "error", "purchase", "signup", "view")


def z(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.features import z_table
    return z_table(dev(spark, sf))


block("z", """
SELECT symbol, ts, CASE WHEN dev IS NOT NULL THEN greatest(least(dev, 1), -1) / theta END AS z
FROM (SELECT symbol, unnest(generate_series(a, b, 3600)) AS ts
      FROM (SELECT DISTINCT symbol FROM dev), (SELECT min(ts) AS a, max(ts) AS b FROM dev))
LEFT JOIN (SELECT symbol, ts, dev, theta FROM dev) USING (symbol, ts)
""", ["dev"])


@staged
def exposure_table(spark: SparkSession, sf: str) -> DataFrame:
    """Dollar measures per asset-hour from the value sampled in the day before; those of assets numbered 3 are unknown."""
    value = F.when(~F.col("symbol").endswith("_3"), F.col("price"))
    hourly = scanned(spark, sf).groupBy(
        "symbol", (F.floor(F.col("ts") / HOUR) * HOUR).cast("bigint").alias("ts")).agg(F.sum(value).alias("v"))
    dense = X.densify(hourly, ["symbol"])
    total = F.round(F.sum("v").over(X.ordered(["symbol"]).rowsBetween(-23, 0)) * 100, 4)
    summed = dense.select("symbol", "ts", total.alias("total")).withColumn("own", F.coalesce("total", F.lit(0.0)))
    return summed.select("symbol", "ts", *[F.expr(x).cast("double").alias(c) for c, x in EXPO_SQL.items()])


block("expo_raw", "SELECT symbol, ts, " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in EXPO_SQL.items()) + """
FROM (SELECT *, coalesce(total, 0) AS own FROM (
  SELECT symbol, ts, round(sum(v) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) * 100, 4) AS total
  FROM (SELECT symbol, unnest(generate_series(min(h), max(h), 3600)) AS ts FROM hs GROUP BY symbol)
  LEFT JOIN (SELECT symbol, h AS ts, v FROM hs) USING (symbol, ts)))
""", ["hs"])
block("hs", "SELECT symbol, ts // 3600 * 3600 AS h, sum(CASE WHEN NOT suffix(symbol, '_3') THEN price END) AS v FROM scanned GROUP BY ALL", ["scanned"])


def wrapper_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return registry(spark, sf).filter(F.col("symbol").endswith("_1")).select(
        F.col("symbol").alias("wrapper"), F.concat("category", F.lit("_0")).alias("underlying"))


def base_prices(spark: SparkSession, sf: str) -> DataFrame:
    return prices(spark, sf).filter((F.col("symbol") == BASE) & (F.col("source") == "main")).select("ts", "price")


def usd_assets(spark: SparkSession, sf: str) -> DataFrame:
    return registry(spark, sf).filter("peg = 'USD'")


@staged
def onset(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators import features as FX
    zz, eps = z(spark, sf), clean_episodes(spark, sf)
    roll = FX.rolling(zz)
    return FX.onset_table(
        labels(spark, sf), roll, FX.history(eps, zz), FX.market(zz, eps, base_prices(spark, sf), usd_assets(spark, sf)),
        FX.wrapped(roll, wrapper_pairs(spark, sf), ["z_now", "z_min_24h"]),
        FX.exposure(exposure_table(spark, sf), EXPO_USD, EXPO_CHANGE, EXPO_RAW), CATEGORIES, RULES)


# ------------------------------------------------------------------------------------------------ tables
LANDMARKS = (1, 6, 24)


@staged
def escalation(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.tables import escalation as build
    from pegwatch.operators import features as FX
    under = FX.wrapped(FX.rolling(z(spark, sf)), wrapper_pairs(spark, sf), ["z_now"])
    return build(clean_episodes(spark, sf), dev(spark, sf), LANDMARKS, RULES, under)


@staged
def seeds(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.tables import seeds as build
    return build(clean_episodes(spark, sf), dev(spark, sf), "severe", RULES)


@staged
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    from pegwatch.operators.tables import candidates
    return candidates(seeds(spark, sf), clean_episodes(spark, sf), dev(spark, sf))


block("severe_ts", """
SELECT symbol, t0, min(ts) FILTER (greatest(dev_obs, p) <= -0.60007 AND p IS NOT NULL) AS severe_ts
FROM (SELECT e.symbol, e.t0, d.ts, dev_obs, lag(dev_obs) OVER (PARTITION BY e.symbol, e.t0 ORDER BY d.ts) AS p
      FROM clean_eps e JOIN dev d ON d.symbol = e.symbol AND d.ts BETWEEN e.t0 AND e.t1 WHERE dev_obs IS NOT NULL)
GROUP BY symbol, t0
""", ["clean_eps", "dev"])
block("seeds", """
SELECT *, CASE WHEN min(tau) OVER (PARTITION BY cluster) <= 1705881600 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, CAST(sum(CASE WHEN tau - p <= 259200 THEN 0 ELSE 1 END) OVER (ORDER BY tau, seed) - 1 AS BIGINT) AS cluster
  FROM (SELECT *, lag(tau) OVER (ORDER BY tau, seed) AS p FROM (
    SELECT symbol || '@' || t0 AS seed_id, symbol AS seed, t0 AS seed_t0, severity AS seed_severity, category AS seed_category,
           peg AS seed_peg, greatest(severe_ts, tk) AS tau
    FROM clean_eps LEFT JOIN severe_ts USING (symbol, t0) WHERE severity IN ('major', 'collapse'))))
""", ["clean_eps", "severe_ts"])
block("pairs", """
SELECT s.*, a.symbol AS cand,
""" + ", ".join(f"""CASE WHEN tau + {w} * 3600 <= (SELECT max(ts) FROM dev) THEN CAST(EXISTS (
  SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.t0 > tau AND e.t0 <= tau + {w} * 3600) AS INT) END AS y{w}""" for w in (72, 168)) + """
FROM seeds s, (SELECT DISTINCT symbol FROM dev) a
WHERE a.symbol <> seed
  AND EXISTS (SELECT 1 FROM dev d WHERE d.symbol = a.symbol AND dev IS NOT NULL AND d.ts BETWEEN tau - 86400 AND tau)
  AND NOT EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.t0 <= tau AND e.t1 > tau - 86400)
  AND NOT EXISTS (SELECT 1 FROM clean_eps e WHERE e.symbol = a.symbol AND e.terminal AND e.t0 <= tau)
""", ["seeds", "clean_eps", "dev"])
