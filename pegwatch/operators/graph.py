"""Lending graph: market, vault and pool snapshots, data-quality rules, typed edges, token measures and pair links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.functions.ranks import exact_quantiles
from pegwatch.operators.series import asof_grid, price_lookup
from pegwatch.rules import DAY, HOUR, ZERO_ADDRESS
from pegwatch.session import cut

# Oracle classes that do not see a market depeg, prefixes of derived tokens, history fields,
# the patterns that tell an exchange-rate feed and a reference-asset price by their descriptions, and what ranks equal times as ``finest``.
BLIND = ("fixed", "vault_rate", "rate_feed")
DERIVED_PREFIXES = ("PT", "YT", "LP", "SY")
MARKET_FIELDS = ("supplyAssetsUsd", "borrowAssetsUsd", "collateralAssetsUsd", "collateralAssets")
RATE_PATTERN = r"(?i)exchange rate|fundamental|redemption|conversion|rate provider|\bnav\b"
REFERENCE_PATTERN = r"(?i)^\s*(W?ETH|W?BTC|USDC|USDT)\s*/\s*(USD|W?ETH|W?BTC)\s*$"

FINEST = ("prio", "value")
EDGE_COLUMNS = ("t", "src", "dst", "etype", "usd", "tokens", "lltv", "ltv", "liq_threshold", "emode_ltv",
                "oracle_class", "frozen", "flag")


# ------------------------------------------------------------------------------------------------ row rules
def plain_symbol(symbol) -> Column:
    """Upper-case symbol, with wrapped ETH and BTC read as the asset itself."""
    s = F.upper(F.trim(F.coalesce(S.col(symbol), F.lit(""))))
    return F.when(s.isin("WETH", "WBTC"), F.substring(s, 2, 10)).otherwise(s)


def classify(markets: DataFrame, feeds: DataFrame) -> DataFrame:
    """Oracle class of each market from its base feeds' descriptions and its base vault.

    ``markets``: market_id, oracle_address, standard, base_vault, collateral_symbol; ``feeds``: one row per base feed.
    """
    text = F.trim(F.coalesce("description", F.lit("")))
    target = feeds.join(markets.select("market_id", "collateral_symbol"), "market_id")
    rate = text.rlike(RATE_PATTERN)
    ref = text.rlike(REFERENCE_PATTERN) & (
        plain_symbol(F.regexp_extract(text, REFERENCE_PATTERN, 1)) != plain_symbol("collateral_symbol"))
    per = target.groupBy("market_id").agg(
        F.count("*").alias("_n"), F.bool_and(text != "").alias("_named"), F.bool_or(rate).alias("_rate"),
        F.bool_and(rate | ref).alias("_known"))
    has_vault = ~F.coalesce(F.lower("base_vault"), F.lit("")).isin("", ZERO_ADDRESS)
    blank = F.coalesce(F.lower("oracle_address"), F.lit("")).isin("", ZERO_ADDRESS)
    without_market_price = F.when(has_vault, "vault_rate").otherwise("fixed")
    return markets.join(per, "market_id", "left").withColumn("oracle_class", (
        F.when(blank, "none").when(~F.col("standard"), "custom")
        .when(F.coalesce("_n", F.lit(0)) == 0, without_market_price)
        .when(~F.col("_named") | ~F.col("_known"), "feed").when(F.col("_rate"), "rate_feed")
        .otherwise(without_market_price)
    )).drop("_n", "_named", "_rate", "_known")


def reclassify(markets: DataFrame, feeds: DataFrame, old: str = "saved_class") -> DataFrame:
    """How many markets move from which class to which; none and custom are kept as saved."""
    new = F.when(F.col(old).isin("none", "custom"), F.col(old)).otherwise(F.col("oracle_class"))
    return classify(markets, feeds).select(F.col(old).alias("old"), new.alias("new")).groupBy("old", "new").agg(
        F.count("*").alias("markets"))


def config_fields(words: DataFrame, word: str = "config") -> DataFrame:
    """Fields of a packed reserve configuration word written as hex."""
    w = S.hex_word(word)
    bonus = S.hex_bits(w, 32, 16)
    return words.select(
        "*", (S.hex_bits(w, 0, 16) / 1e4).alias("ltv"), (S.hex_bits(w, 16, 16) / 1e4).alias("liq_threshold"),
        F.when(bonus != 0, F.round(bonus / 1e4 - 1, 6)).otherwise(0.0).alias("liq_bonus"),
        S.hex_bits(w, 48, 8).alias("decimals"), S.hex_bits(w, 56, 1).alias("active"), S.hex_bits(w, 57, 1).alias("frozen"),
        S.hex_bits(w, 58, 1).alias("borrowing_enabled"), S.hex_bits(w, 60, 1).alias("paused"),
        (S.hex_bits(w, 64, 16) / 1e4).alias("reserve_factor"), S.hex_bits(w, 80, 36).alias("borrow_cap"),
        S.hex_bits(w, 116, 36).alias("supply_cap"), S.hex_bits(w, 168, 8).alias("emode_legacy"),
        (S.hex_bits(w, 212, 40) / 100).alias("debt_ceiling"))


def decode_reserves(raw: DataFrame) -> DataFrame:
    """Raw reserve reads to scaled amounts; a reserve without a configuration word is not listed yet."""
    listed = config_fields(raw.filter(S.hex_word("config").isNotNull() & (F.regexp_replace("config", "0|x", "") != "")))
    unit = F.pow(F.lit(10.0), F.col("decimals"))
    return listed.select(
        "pool", "asset", "ts", *[(F.expr(f"try_cast({c} as double)") / unit).alias(c) for c in ("supply", "variable_debt", "stable_debt")],
        (F.expr("try_cast(price as double)") / F.col("base_unit")).alias("price_usd"), "ltv", "liq_threshold", "liq_bonus",
        "reserve_factor", "active", "frozen", "borrowing_enabled", "paused", "supply_cap", "borrow_cap", "debt_ceiling",
        "emode_legacy", "reserve_id")


def decode_categories(raw: DataFrame) -> DataFrame:
    """E-mode category reads in basis points; a category with neither ratio nor threshold is dropped."""
    bonus = F.col("bonus_bps")
    return raw.filter("coalesce(ltv_bps, 0) <> 0 or coalesce(threshold_bps, 0) <> 0").select(
        "pool", "ts", "category", (F.col("ltv_bps") / 1e4).alias("ltv"), (F.col("threshold_bps") / 1e4).alias("liq_threshold"),
        F.when(bonus != 0, F.round(bonus / 1e4 - 1, 6)).otherwise(0.0).alias("liq_bonus"), "collateral_bitmap", "mode")


def check_readings(raw: DataFrame, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Raw 18-decimal rate readings to values with an ok flag and a plausibility mark."""
    value = F.expr("try_cast(raw as decimal(38,0))").cast("double") / 1e18
    return raw.select("symbol", "ts", value.alias("rate"), value.isNotNull().cast("int").alias("ok"),
                      F.coalesce(value.between(low, high), F.lit(False)).alias("plausible"))


def short_id(ids: DataFrame, column: str, prefix: str, width: int = 14) -> Column:
    """Node id of a full id: the first characters if none of ``ids`` collide, else the full id."""
    clash = ids.select(column).distinct().groupBy(F.substring(column, 1, width)).count().agg(F.max("count")).scalar()
    body = F.when(clash > 1, F.col(column)).otherwise(F.substring(column, 1, width))
    return F.concat(F.lit(prefix), body)


def short_ids(ids: DataFrame, column: str, prefix: str, width: int = 14) -> DataFrame:
    return ids.withColumn("node", short_id(ids, column, prefix, width))


def derivative_edges(tokens: DataFrame, registry: DataFrame) -> DataFrame:
    """Static edges from derived tokens (PT-, YT-, LP-, SY-) to the registry symbol they name first."""
    parts = F.split("symbol", "[-_ ]")
    named = (
        tokens.filter(F.upper(F.element_at(parts, 1)).isin(*DERIVED_PREFIXES))
        .select("address", F.posexplode(parts).alias("pos", "part")).filter("pos > 0")
    )
    known = registry.select(F.lower("symbol").alias("_key"), F.col("symbol").alias("target"))
    hit = named.join(known, F.lower("part") == F.col("_key")).groupBy("address").agg(F.min_by("target", F.struct("pos", "target")).alias("target"))
    return hit.select(F.concat(F.lit("tok:"), "address").alias("src"), F.concat(F.lit("tok:"), "target").alias("dst"),
                      F.lit("derivative").alias("etype"))


def wrapper_edges(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.select("symbol")
    return (
        pairs.join(known.withColumnRenamed("symbol", "wrapper"), "wrapper", "left_semi")
        .join(known.withColumnRenamed("symbol", "underlying"), "underlying", "left_semi")
        .select(F.concat(F.lit("tok:"), "wrapper").alias("src"), F.concat(F.lit("tok:"), "underlying").alias("dst"),
                F.lit("wrapper").alias("etype"))
    )


def select_vaults(allocations: DataFrame, vaults: DataFrame, markets: DataFrame) -> DataFrame:
    """Vaults that allocate to a selected market, else those that lend one of the selected loan assets."""
    by_alloc = allocations.join(markets.select("market_id"), "market_id", "left_semi").select("vault", F.lit(1).alias("_a")).distinct()
    by_asset = markets.select(F.col("loan").alias("asset"), F.lit(1).alias("_b")).distinct()
    out = vaults.join(by_alloc, "vault", "left").join(by_asset, "asset", "left")
    return out.withColumn("selected_by", F.when(F.col("_a") == 1, "allocation").when(F.col("_b") == 1, "asset")).filter(
        "selected_by is not null").drop("_a", "_b")


def select_markets(markets: DataFrame, targets: DataFrame) -> DataFrame:
    """Markets whose collateral or loan asset is a target."""
    hit = targets.select(F.col("symbol").alias("_s"))
    return markets.join(hit, F.col("_s") == F.col("collateral"), "left_semi").unionByName(
        markets.join(hit, F.col("_s") == F.col("loan"), "left_semi")).dropDuplicates(["market_id"])


def activity(history: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Largest value per id and the padded window in which it was positive."""
    rows = history.filter(F.col("field").isin(*fields))
    positive = F.when(F.col("value") > 0, F.col("ts"))
    return rows.groupBy(key).agg(
        F.max(F.greatest("value", F.lit(0.0))).alias("max_value"), (F.min(positive) - DAY).alias("from_ts"),
        (F.max(positive) + 2 * DAY).alias("to_ts"))


# ------------------------------------------------------------------------------------------------ snapshots
def finest(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value per key and availability time: the finer interval wins, the larger value among equals."""
    return history.groupBy(*keys, "avail_ts").agg(F.max_by("value", F.struct("prio", "value")).alias("value"))


def prices_at(asks: DataFrame, prices: DataFrame) -> DataFrame:
    """symbol, ts, market_price of the asked times, written: the table's size is known where rows are valued, so a small one meets
    them without moving them."""
    return cut(price_lookup(asks.select("symbol", "ts").distinct(), prices), "asked_prices")


def market_snapshots(history: DataFrame, markets: DataFrame, prices: DataFrame, max_stale: int, start: int, step: int,
                     end, asks: DataFrame | None = None) -> DataFrame:
    """One row per (snapshot, market) with a column per field; unpriced collateral is valued at the market price. ``asks``: the
    (symbol, ts) that can be priced, where that is known beforehand. History dealt by market isn't moved again."""
    held = asof_grid(history, ["market_id", "field"], max_stale, start, step, end, rank=FINEST)
    wide = held.groupBy("t", "market_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in MARKET_FIELDS])
    out = wide.join(markets.select("market_id", "collateral", "loan", "lltv", "oracle_class", F.col("node").alias("m_node")), "market_id")
    blank = (F.col("collateralAssetsUsd") == 0) & (F.col("collateralAssets") > 0)
    out = out.withColumn("collateralAssetsUsd", F.when(~F.coalesce(blank, F.lit(False)), F.col("collateralAssetsUsd")))
    need = F.col("collateralAssetsUsd").isNull() & F.col("collateralAssets").isNotNull()
    asks = out.filter(need).select(F.col("collateral").alias("symbol"), F.col("t").alias("ts")) if asks is None else asks
    priced = prices_at(asks, prices).select(F.col("symbol").alias("collateral"), F.col("ts").alias("t"), "market_price")
    out = out.join(priced, ["collateral", "t"], "left")
    usd = F.when(need, F.col("collateralAssets") * F.col("market_price")).otherwise(F.col("collateralAssetsUsd"))
    return out.withColumn("collateralAssetsUsd", usd).drop("market_price")


def vault_snapshots(history: DataFrame, vaults: DataFrame, prices: DataFrame, max_stale: int, start: int, step: int,
                    end, asks: DataFrame | None = None) -> DataFrame:
    """Allocations (and totals, under an empty market id) per snapshot in USD, with their vault's asset; token units are
    valued at their time. ``asks``: the (symbol, ts) that can be priced, where that is known beforehand. History dealt by vault isn't
    moved again."""
    tagged = history.join(vaults.select("vault", F.col("asset").alias("symbol")), "vault")
    in_usd = F.col("field").endswith("Usd")
    priced = prices_at(tagged.filter(~in_usd) if asks is None else asks, prices)
    rows = tagged.join(priced, ["symbol", "ts"], "left").withColumn(
        "value", F.when(in_usd, F.col("value")).otherwise(F.col("value") * F.col("market_price"))).withColumn(
        "field", F.regexp_replace("field", "Assets$", "AssetsUsd")).withColumnRenamed("symbol", "asset")
    keys = ["vault", "market_id", "field"]
    rows = rows.withColumn("_key", F.xxhash64(*keys))  # names begin alike, so a sort by them alone compares them whole
    return asof_grid(rows, ["_key", *keys], max_stale, start, step, end, rank=FINEST).filter("value > 0").select("t", *keys, "asset", "value")


def insolvency_runs(markets: DataFrame, min_debt: float) -> DataFrame:
    """market_id, t, began, supply_then, debt_then: the snapshots at which the last known collateral covers less than half of a
    debt above ``min_debt``, each with the start of its unbroken run of such snapshots and the levels there."""
    by_time = Window.partitionBy("market_id").orderBy("t")
    thin = F.col("collateralAssetsUsd") < F.col("borrowAssetsUsd") / 2
    placed = markets.select(
        "market_id", "t", "supplyAssetsUsd", "borrowAssetsUsd", F.row_number().over(by_time).alias("place"),
        F.last(thin, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("thin"))
    insolvent = placed.filter(F.col("thin") & (F.col("borrowAssetsUsd") > min_debt))
    numbered = insolvent.withColumn("run", F.col("place") - F.row_number().over(by_time))  # the same along a run
    runs = numbered.groupBy("market_id", "run").agg(
        F.min("t").alias("began"), F.min_by("supplyAssetsUsd", "t").alias("supply_then"), F.min_by("borrowAssetsUsd", "t").alias("debt_then"))
    return numbered.select("market_id", "run", "t").join(runs, ["market_id", "run"]).drop("run")


def unverifiable_snapshots(markets: DataFrame, big_supply: float, patience: int) -> DataFrame:
    """market_id, t: snapshots of markets that have been large for ``patience``, never showed collateral and were nearly always lent out."""
    so_far = Window.partitionBy("market_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    large = F.col("supplyAssetsUsd") > big_supply
    drained = large & (F.col("borrowAssetsUsd") >= F.col("supplyAssetsUsd") * 0.999)
    tally = markets.select(
        "market_id", "t", F.min(F.when(large, F.col("t"))).over(so_far).alias("large_since"), F.count(F.when(large, 1)).over(so_far).alias("large"),
        F.count(F.when(drained, 1)).over(so_far).alias("drained"), F.count(F.when(F.col("collateralAssetsUsd") > 0, 1)).over(so_far).alias("backed"))
    return tally.filter((F.col("t") - F.col("large_since") >= patience) & (F.col("backed") == 0) & (F.col("drained") >= 0.9 * F.col("large"))).select("market_id", "t")


def clean_markets(mm: DataFrame, min_debt: float = 1e5, hold: int = 48 * HOUR, big_supply: float = 1e6,
                  unverifiable: int = 2 * DAY) -> DataFrame:
    """Market snapshots with their verdict. A debt insolvent for ``hold`` is frozen at no more than its level when that began; what
    can't be verified is unknown. Every verdict at t uses snapshots up to t. Adds ``flag``, ``frozen_from`` and the raw borrow."""
    frozen = insolvency_runs(mm, min_debt).filter(F.col("t") - F.col("began") >= hold)
    doubtful = unverifiable_snapshots(mm, big_supply, unverifiable).withColumn("doubtful", F.lit(True))
    judged = mm.join(frozen, ["market_id", "t"], "left").join(doubtful, ["market_id", "t"], "left")
    known = F.col("doubtful").isNull()
    return judged.select(
        "t", "market_id", *(c for c in mm.columns if c == "m_node"), "collateral", "loan", "lltv", "oracle_class", "collateralAssets",
        F.when(known, F.least("supplyAssetsUsd", "supply_then")).alias("supplyAssetsUsd"),  # least() passes over what no freeze limits
        F.when(known, F.least("borrowAssetsUsd", "debt_then")).alias("borrowAssetsUsd"),
        F.when(known, F.col("collateralAssetsUsd")).alias("collateralAssetsUsd"), F.col("borrowAssetsUsd").alias("raw_borrow"),
        F.when(~known, "unverifiable").when(F.col("began").isNotNull(), "bad_debt_freeze").otherwise("").alias("flag"), F.col("began").alias("frozen_from"))


def market_flags(mm: DataFrame) -> DataFrame:
    return mm.filter("flag <> ''").groupBy("market_id", F.col("flag").alias("rule")).agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("snapshots"),
        F.max("raw_borrow").alias("max_raw_borrow"), F.max("borrowAssetsUsd").alias("max_kept_borrow"))


def judged_allocations(parts: DataFrame, mm: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """Allocations with the verdict on their market, what of each still counts (nothing where the market can't be verified, no more than
    at the start of a freeze) and the excess. Adds ``listed`` and ``collateral`` of the market's snapshot at that time and, from
    ``markets``, its node. The rows are dealt by market once: a market's snapshots come as one map, a vault's earlier values there as one
    array, both bounded by the number of snapshots."""
    verdicts = mm.groupBy("market_id").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("collateral", "flag", "frozen_from")))).alias("_seen"))
    if markets is not None:
        verdicts = markets.select("market_id", F.col("node").alias("m_node")).join(verdicts, "market_id", "full")
    met = parts.join(verdicts, "market_id", "left").withColumn("_m", F.try_element_at("_seen", F.col("t"))).drop("_seen")
    past = F.collect_list(F.struct("t", "value")).over(Window.partitionBy("market_id", "vault"))
    then = F.get(F.filter("_past", lambda x: x["t"] == F.col("_m.frozen_from")), F.lit(0))["value"]
    allowed = F.when(F.col("_m.flag") == "unverifiable", 0.0).when(F.col("_m.flag") != "", F.least("value", then)).otherwise(F.col("value"))
    return met.withColumn("_past", past).withColumn("_allowed", allowed).select(
        *(c for c in met.columns if c not in ("_m", "value")), F.col("_m").isNotNull().alias("listed"), "_m.collateral",
        F.coalesce("_m.flag", F.lit("")).alias("flag"), F.col("_allowed").alias("value"), (F.col("value") - F.col("_allowed")).alias("excess"))


def clean_vaults(va: DataFrame, mm: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """Allocations as far as they count, and the vaults' totals (rows without a market) less the excess of their flagged allocations."""
    is_total = F.coalesce(F.col("market_id") == "", F.lit(False))
    parts = cut(judged_allocations(va.filter(~is_total).drop("asset"), mm, markets), "judged")
    excess = parts.filter("flag <> ''").groupBy("vault", "t").agg(F.sum("excess").alias("excess"))
    totals = va.filter(is_total).join(excess, ["vault", "t"], "left").withColumn("value", F.col("value") - F.coalesce("excess", F.lit(0.0))).drop("excess")
    return parts.drop("excess").unionByName(totals.withColumn("flag", F.lit("")), allowMissingColumns=True).filter("value > 0")


def asked_allocations(va: DataFrame, mm: DataFrame, asked: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """The judged allocations (no totals) of the asked snapshots: of other snapshots only those at which a freeze began enter."""
    seen = mm.join(asked, "t", "left_semi")
    needed = cut(asked.select("t").unionByName(seen.filter("frozen_from is not null").select(F.col("frozen_from").alias("t"))).distinct(), "needed_times")
    parts = va.filter(~F.coalesce(F.col("market_id") == "", F.lit(False))).join(needed, "t", "left_semi")
    return judged_allocations(parts, seen, markets).join(asked, "t", "left_semi").drop("excess").filter("value > 0")


def emode_ltv(reserves: DataFrame, categories: DataFrame) -> DataFrame:
    """Highest e-mode ratio each reserve row can use, 0 if none: bitmap membership, or the legacy category id."""
    cats = categories.filter("ltv > 0").select("pool", "ts", "category", F.col("ltv").alias("_l"), "collateral_bitmap", "mode")
    rid = F.coalesce(F.col("reserve_id"), F.lit(-1))
    by_map = (F.col("mode") == "bitmap") & (rid >= 0)
    member = F.when(by_map, F.coalesce(S.bit_set("collateral_bitmap", F.greatest(rid, F.lit(0))), F.lit(False))).otherwise(
        F.coalesce("emode_legacy", F.lit(0)) == F.col("category"))
    best = reserves.select("pool", "asset", "ts", "reserve_id", "emode_legacy").join(cats, ["pool", "ts"]).filter(member).groupBy(
        "pool", "asset", "ts").agg(F.max("_l").alias("emode_ltv"))
    return reserves.join(best, ["pool", "asset", "ts"], "left").withColumn("emode_ltv", F.coalesce("emode_ltv", F.lit(0.0)))


def pool_snapshots(reserves: DataFrame, max_stale: int, start: int, step: int, end) -> DataFrame:
    rows = reserves.withColumn("avail_ts", F.col("ts")).drop("ts")
    held = asof_grid(rows, ["pool", "asset"], max_stale, start, step, end).filter("supply is not null")
    debt = F.coalesce("variable_debt", F.lit(0.0)) + F.coalesce("stable_debt", F.lit(0.0))
    return held.withColumn("supply_usd", F.col("supply") * F.col("price_usd")).withColumn(
        "debt_usd", debt * F.col("price_usd")).withColumn(
        "frozen_any", ((F.coalesce("frozen", F.lit(0)) > 0) | (F.coalesce("paused", F.lit(0)) > 0)).cast("int"))


# ------------------------------------------------------------------------------------------------ edges and nodes
def token_node(symbol) -> Column:
    return F.concat(F.lit("tok:"), S.col(symbol))


def _sides(rows: DataFrame, *sides: tuple[Column, dict[str, Column]]) -> DataFrame:
    """Every edge that a row stands for, in one pass: a side is its condition and its columns."""
    made = [F.when(when, F.struct(*[cols.get(c, F.lit(None)).alias(c) for c in EDGE_COLUMNS])) for when, cols in sides]
    return rows.select(F.explode(F.array_compact(F.array(*made))).alias("e")).select("e.*")


def market_edges(mm: DataFrame) -> DataFrame:
    """Collateral, supply and borrow edges of every market snapshot."""
    c = F.col
    own = {k: c(k) for k in ("t", "lltv", "oracle_class", "flag")}
    return _sides(
        mm,
        (F.coalesce("collateral", F.lit("")) != "", own | {"etype": F.lit("collateral"), "src": token_node("collateral"), "dst": c("m_node"),
                                                           "usd": c("collateralAssetsUsd"), "tokens": c("collateralAssets")}),
        (F.lit(True), own | {"etype": F.lit("supply"), "src": token_node("loan"), "dst": c("m_node"), "usd": c("supplyAssetsUsd")}),
        (F.lit(True), own | {"etype": F.lit("borrow"), "src": c("m_node"), "dst": token_node("loan"), "usd": c("borrowAssetsUsd")}))


def edges(mm: DataFrame, va: DataFrame, aa: DataFrame, vault_node: Column) -> DataFrame:
    """The seven edge types of every snapshot in one table; each snapshot table is read once and, as its rows name their nodes, moved nowhere."""
    c, always = F.col, F.lit(True)
    value = {"t": c("t"), "usd": c("value")}
    vault = _sides(
        va,
        ((c("market_id") != "") & c("m_node").isNotNull(), value | {"etype": F.lit("allocation"), "src": vault_node, "dst": c("m_node"), "flag": c("flag")}),
        (c("market_id") == "", value | {"etype": F.lit("vault_asset"), "src": token_node("asset"), "dst": vault_node}))
    at, token = F.concat(F.lit("pool:"), "pool"), token_node("asset")
    held = {"t": c("t"), "frozen": c("frozen_any")}
    pool = _sides(
        aa,
        (always, held | {"etype": F.lit("pool_supply"), "src": token, "dst": at, "usd": c("supply_usd"), "tokens": c("supply"),
                         **{k: c(k) for k in ("ltv", "liq_threshold", "emode_ltv")}}),
        (always, held | {"etype": F.lit("pool_borrow"), "src": at, "dst": token, "usd": c("debt_usd")}))
    return market_edges(mm).unionByName(vault).unionByName(pool)


def nodes(registry: DataFrame, markets: DataFrame, vaults: DataFrame, pools: DataFrame) -> DataFrame:
    """Tokens of the registry first, then unseen tokens of markets and vaults, markets, vaults and pools."""
    reg = registry.select(token_node("symbol").alias("node_id"), F.lit("token").alias("ntype"), "symbol", F.lit(0).alias("_p"))
    seen = None
    for i, (df, c) in enumerate(((markets, "collateral"), (markets, "loan"), (vaults, "asset")), start=1):
        part = df.filter(F.coalesce(F.col(c), F.lit("")) != "").select(
            token_node(c).alias("node_id"), F.lit("token").alias("ntype"), F.col(c).alias("symbol"), F.lit(i).alias("_p"))
        seen = part if seen is None else seen.unionByName(part)
    others = [
        markets.select(F.col("node").alias("node_id"), F.lit("market").alias("ntype"), F.concat_ws("/", "collateral", "loan").alias("symbol"),
                       F.lit(9).alias("_p"), "lltv", "oracle_class"),
        vaults.select(F.col("node").alias("node_id"), F.lit("vault").alias("ntype"), F.col("vault").alias("symbol"), F.lit(9).alias("_p"), "asset"),
        pools.select(F.concat(F.lit("pool:"), "pool").alias("node_id"), F.lit("pool").alias("ntype"), F.col("pool").alias("symbol"), F.lit(9).alias("_p")),
    ]
    out = reg.unionByName(seen)
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in ("node_id", "_p")]
    return out.groupBy("node_id").agg(F.min_by(F.struct(*cols), F.struct("_p", *cols)).alias("n")).select("node_id", "n.*")


# ------------------------------------------------------------------------------------------------ families
def closure(static: DataFrame) -> DataFrame:
    """(root, member): everything that wraps or derives from a root, directly or through others. Each round joins only
    the newly found pairs with the edges; rounds end with the longest chain, and each one is cut to storage."""
    step = static.select(F.col("dst").alias("via"), F.col("src").alias("member")).distinct()
    found = cut(step.select(F.col("via").alias("root"), "member"), "closure")
    frontier = found
    while True:
        new = frontier.select("root", F.col("member").alias("via")).join(step, "via").select("root", "member").distinct()
        new = cut(new.join(found, ["root", "member"], "left_anti"), "closure_new")
        if new.isEmpty():
            return found
        found, frontier = found.unionByName(new), new


def components(static: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(node, family): connected components over undirected static edges, named by their smallest node.

    Label propagation with pointer jumping: the number of rounds grows with the logarithm of the diameter. The join
    on a hub splits under skew handling because the label side has one row per node.
    """
    both = static.select("src", "dst").unionByName(static.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ids = node_ids.select(F.col("node_id").alias("node")).unionByName(both.select(F.col("src").alias("node"))).distinct()
    labels = cut(ids.withColumn("family", F.col("node")), "family")
    both = cut(both, "family_edges")
    while True:
        near = both.join(labels.select(F.col("node").alias("src"), "family"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.min("family").alias("_n"))
        step = labels.join(near, "node", "left").select("node", F.col("family").alias("_old"), F.least("family", "_n").alias("_new"))
        jump = step.select(F.col("node").alias("_new"), F.col("_new").alias("_up"))
        nxt = cut(step.join(jump, "_new", "left").select("node", "_old", F.least("_new", "_up").alias("family")), "family")
        labels = nxt.select("node", "family")
        if nxt.filter("family <> _old").isEmpty():
            return labels


# ------------------------------------------------------------------------------------------------ token measures
def collateral_measures(mm: DataFrame, pegs: DataFrame, min_usd: float = 1e4) -> DataFrame:
    """The measures per (token, snapshot) of the markets that take the token as collateral; they need no allocations and no pools."""
    c, b = F.col("collateralAssetsUsd"), F.col("borrowAssetsUsd")
    peg_c = pegs.select(F.col("symbol").alias("collateral"), F.col("peg").alias("_pc"))
    peg_l = pegs.select(F.col("symbol").alias("loan"), F.col("peg").alias("_pl"))
    usable = mm.filter(F.coalesce("collateral", F.lit("")) != "").join(peg_c, "collateral", "left").join(peg_l, "loan", "left")
    total = F.sum(c)
    share = lambda x: F.when(total >= min_usd, F.try_divide(F.sum(x), total))
    listed = (c >= min_usd) | (c.isNull() & (b >= min_usd))
    return usable.groupBy(F.col("collateral").alias("symbol"), "t").agg(
        F.count(F.when(listed, 1)).alias("mm_n_markets"), total.alias("mm_collateral_usd"), F.sum(b).alias("mm_borrow_against_usd"),
        share(F.col("lltv") * c).alias("mm_lltv_wavg"),
        share(c * F.col("oracle_class").isin(*BLIND).cast("int")).alias("mm_blind_oracle_share"),
        share(c * (F.col("oracle_class") == "custom").cast("int")).alias("mm_custom_oracle_share"),
        F.sum(F.when(F.col("_pc") == F.col("_pl"), b)).alias("mm_pegged_loop_usd"))


def token_measures(mm: DataFrame, va: DataFrame, aa: DataFrame, pegs: DataFrame, prices: DataFrame, family: DataFrame,
                   min_usd: float = 1e4) -> DataFrame:
    """The exposure measures per (token, snapshot). One aggregation per side, joined on (symbol, t)."""
    keys = ["symbol", "t"]
    b = F.col("borrowAssetsUsd")
    col = collateral_measures(mm, pegs, min_usd)
    loan = mm.groupBy(F.col("loan").alias("symbol"), "t").agg(
        F.sum("supplyAssetsUsd").alias("mm_supply_usd"), F.sum(b).alias("mm_borrowed_usd"))
    alloc = va.filter("market_id <> '' and collateral is not null").withColumn("symbol", F.col("collateral"))
    per_vault = alloc.groupBy("symbol", "t", "vault").agg(F.sum("value").alias("_v"), F.max((F.col("value") >= min_usd).cast("int")).alias("_big"))
    vault = per_vault.groupBy("symbol", "t").agg(F.sum("_v").alias("vault_exposure_usd"), F.sum("_big").alias("vault_n"))
    gap = price_lookup(aa.select(F.col("asset").alias("symbol"), F.col("t").alias("ts")).distinct(), prices).select(
        F.col("symbol").alias("asset"), F.col("ts").alias("t"), "market_price")
    pool_rows = aa.join(gap, ["asset", "t"], "left")
    s = F.col("supply_usd")
    fair = (s > 0) & F.col("market_price").isNotNull() & F.col("price_usd").isNotNull()
    off = F.try_divide("price_usd", "market_price") - 1
    cap = F.when(F.col("supply_cap") > 0, F.try_divide("supply", "supply_cap"))
    best = F.when(F.col("ltv").isNotNull() & F.col("emode_ltv").isNotNull(), F.greatest("ltv", "emode_ltv"))
    pool = pool_rows.groupBy(F.col("asset").alias("symbol"), "t").agg(
        F.coalesce(F.sum(s), F.lit(0.0)).alias("aave_supply_usd"),
        F.when(F.max((F.col("liq_threshold") > 0).cast("int")) == 1, F.coalesce(F.sum(F.when(F.col("liq_threshold") > 0, s)), F.lit(0.0))).alias("aave_collateral_usd"),
        F.coalesce(F.sum("debt_usd"), F.lit(0.0)).alias("aave_borrow_usd"), F.max(best).alias("aave_ltv_max"),
        F.max("frozen_any").alias("aave_frozen"), F.max(cap).alias("aave_supply_cap_use"),
        F.try_divide(F.sum(F.when(fair, off * s)), F.sum(F.when(fair, s))).alias("aave_oracle_gap"))
    direct = col.join(loan, keys, "full").join(vault, keys, "full").join(pool, keys, "full")
    return direct.join(pegs.select("symbol"), "symbol", "left_semi").join(family, keys, "left")


def family_measures(mm: DataFrame, va: DataFrame, aa: DataFrame, closed: DataFrame, pegs: DataFrame) -> DataFrame:
    """Direct measures summed over each registry token and everything that wraps or derives from it."""
    m = mm.filter(F.coalesce("collateral", F.lit("")) != "").select(
        F.col("collateral").alias("member"), "t", F.col("collateralAssetsUsd").alias("c"), F.col("borrowAssetsUsd").alias("b"))
    v = va.filter("market_id <> '' and listed").select(F.col("collateral").alias("member"), "t", F.col("value").alias("v"))
    a = aa.select(F.col("asset").alias("member"), "t", F.when(F.col("liq_threshold") > 0, F.col("supply_usd")).alias("c"), F.col("debt_usd").alias("b"))
    direct = m.unionByName(v, allowMissingColumns=True).unionByName(a, allowMissingColumns=True).groupBy("member", "t").agg(
        *[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in "cbv"])
    roots = pegs.select(F.col("symbol").alias("root"), F.col("symbol").alias("member")).unionByName(
        closed.select(F.substring("root", 5, 1000).alias("root"), F.substring("member", 5, 1000).alias("member")).join(
            pegs.select(F.col("symbol").alias("root")), "root", "left_semi")).distinct()
    return direct.join(roots, "member").groupBy(F.col("root").alias("symbol"), "t").agg(
        F.sum("c").alias("family_collateral_usd"), F.sum("v").alias("family_vault_exposure_usd"), F.sum("b").alias("family_borrow_against_usd"))


def feature_summary(features: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Per measure: tokens with a non-zero value and the median of the non-zero values."""
    doubles = features.select("symbol", *[F.col(c).cast("double").alias(c) for c in measures])
    long = doubles.unpivot(["symbol"], list(measures), "measure", "value")
    some = (F.col("value") != 0) & F.col("value").isNotNull()
    pairs = long.groupBy("measure", "symbol").agg(F.max(some.cast("int")).alias("_some"))
    tokens = pairs.groupBy("measure").agg(F.count(F.when(F.col("_some") == 1, 1)).alias("tokens"))
    return tokens.join(exact_quantiles(long.filter(some), "value", {"median": 0.5}, ["measure"]), "measure", "left")


# ------------------------------------------------------------------------------------------------ pair links
def market_mode(edge_rows: DataFrame, etype: str, market: str, token: str, name: str) -> DataFrame:
    """Most frequent token on one side of each market, the smallest on ties."""
    counts = edge_rows.filter(F.col("etype") == etype).groupBy(F.col(market).alias("market"), F.col(token).alias("_t")).agg(F.count("*").alias("_c"))
    return counts.groupBy("market").agg(F.min_by("_t", F.struct(-F.col("_c"), "_t")).alias(name))


def pair_links(edge_rows: DataFrame, families: DataFrame, pairs: DataFrame, vault_min: float = 1e4) -> DataFrame:
    """Lending, vault and pool links between the families of seed and candidate at the last snapshot before tau.

    ``pairs``: seed, cand (node ids) and tau. Links are computed once per distinct (snapshot, family, family); vaults
    and pools are reached from the seed's side and matched on (snapshot, vault or pool, candidate family), so only the
    asked pairs are ever formed, from the asked snapshots' edges. The asked ones are written: a small table of known size.
    """
    return _links(edge_rows.select("t").distinct(), edge_rows, lambda asked: edge_rows.join(asked, "t", "left_semi"), families, pairs, vault_min)


def snapshot_links(mm: DataFrame, va: DataFrame, aa: DataFrame, markets: DataFrame, vault_node: Column, families: DataFrame, pairs: DataFrame,
                   vault_min: float = 1e4) -> DataFrame:
    """``pair_links`` from the snapshot tables (``va`` not judged yet): edges, and verdicts on allocations, of the asked snapshots alone are
    made and written."""
    times = cut(mm.select("t").unionByName(aa.select("t")).distinct(), "link_times")
    # a snapshot of allocations alone has no verdicts, so each of its rows that names its nodes is an edge
    alone = cut(va.select("t").distinct().join(times, "t", "left_anti"), "stray_times")
    stray = va.filter("value > 0").join(alone, "t", "left_semi").select("t", "market_id")
    named = stray.filter("market_id = ''").unionByName(stray.join(markets.filter("node is not null").select("market_id"), "market_id", "left_semi").select("t", "market_id"))

    def at(asked: DataFrame) -> DataFrame:
        held = asked_allocations(va, mm, asked, markets)
        return cut(edges(mm.join(asked, "t", "left_semi"), held, aa.join(asked, "t", "left_semi"), vault_node), "asked_edges")

    tokens = mm.filter(F.coalesce("collateral", F.lit("")) != "").select(F.lit("collateral").alias("etype"), token_node("collateral").alias("src"), F.col("m_node").alias("dst")).unionByName(
        mm.select(F.lit("borrow").alias("etype"), F.col("m_node").alias("src"), token_node("loan").alias("dst")))
    return _links(times.unionByName(named.select("t")).distinct(), tokens, at, families, pairs, vault_min)


def _links(times: DataFrame, mode_rows: DataFrame, edges_at: Callable[[DataFrame], DataFrame], families: DataFrame, pairs: DataFrame, vault_min: float) -> DataFrame:
    """``mode_rows``: the market edges of all snapshots; ``edges_at``: the edges of the asked ones."""
    fam = lambda df, node, name: df.join(families.select(F.col("node").alias(node), F.col("family").alias(name)), node, "left").withColumn(
        name, F.coalesce(name, node))
    taus = pairs.select("tau").distinct()
    marks = taus.select(F.col("tau").alias("at"), F.lit(1).alias("_side")).unionByName(
        times.select(F.col("t").alias("at"), F.lit(0).alias("_side"), F.col("t").alias("_t")), allowMissingColumns=True)
    snap = marks.withColumn("t", F.last("_t", True).over(Window.orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0))).filter(
        "_side = 1").select(F.col("at").alias("tau"), "t")
    rows = fam(fam(pairs.join(snap, "tau", "left"), "seed", "fs"), "cand", "fc")
    asked = cut(rows.filter("t is not null and fs <> fc").select("t", "fs", "fc").distinct(), "asked_links")
    at_asked = edges_at(asked.select("t").distinct())  # no other snapshot enters a link
    col = fam(market_mode(mode_rows, "collateral", "dst", "src", "_c"), "_c", "col").select("market", "col")
    loan = fam(market_mode(mode_rows, "borrow", "src", "dst", "_l"), "_l", "loan").select("market", "loan")
    lend = at_asked.filter("etype = 'borrow'").select("t", F.col("src").alias("market"), "usd").join(col, "market").join(
        loan, "market").groupBy("t", "col", "loan").agg(F.sum("usd").alias("usd"))
    lend_cs = lend.select("t", F.col("col").alias("fs"), F.col("loan").alias("fc"), F.col("usd").alias("_cs"))
    lend_sc = lend.select("t", F.col("loan").alias("fs"), F.col("col").alias("fc"), F.col("usd").alias("_sc"))
    alloc = at_asked.filter("etype = 'allocation'").select("t", F.col("src").alias("vault"), F.col("dst").alias("market"), "usd")
    total = alloc.groupBy("t", "vault").agg(F.sum("usd").alias("_tot"))
    expo = alloc.join(col, "market").groupBy("t", "vault", F.col("col").alias("fam")).agg(F.sum("usd").alias("usd"))
    seed_side = asked.join(expo.select("t", "vault", F.col("fam").alias("fs"), F.col("usd").alias("_as")), ["t", "fs"])
    both = seed_side.join(expo.select("t", "vault", F.col("fam").alias("fc"), F.col("usd").alias("_ac")), ["t", "vault", "fc"]).join(total, ["t", "vault"])
    cand_total = expo.groupBy("t", F.col("fam").alias("fc")).agg(F.sum("usd").alias("_act"))
    in_vaults = both.groupBy("t", "fs", "fc").agg(
        F.sum(F.least("_as", "_ac")).alias("_vo"), F.sum(F.col("_ac") * F.when(F.col("_tot") > 0, F.try_divide("_as", "_tot")).otherwise(0.0)).alias("_vs"),
        F.count(F.when((F.col("_as") >= vault_min) & (F.col("_ac") >= vault_min), 1)).alias("_vn"))
    is_col = (F.coalesce("liq_threshold", F.lit(0.0)) > 0) | (F.coalesce("emode_ltv", F.lit(0.0)) > 0)
    supplied = at_asked.filter("etype = 'pool_supply'").filter(is_col).select("t", F.col("dst").alias("pool"), F.col("src").alias("n"), "usd")
    owed = at_asked.filter("etype = 'pool_borrow'").select("t", F.col("src").alias("pool"), F.col("dst").alias("n"), "usd")
    pc = fam(supplied, "n", "fam").groupBy("t", "pool", "fam").agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    pd = fam(owed, "n", "fam").groupBy("t", "pool", "fam").agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    seed_pool = asked.join(pc.select("t", "pool", F.col("fam").alias("fs"), F.col("usd").alias("_cs")), ["t", "fs"])
    overlap = seed_pool.join(pc.select("t", "pool", F.col("fam").alias("fc"), "usd"), ["t", "pool", "fc"]).groupBy("t", "fs", "fc").agg(
        F.sum(F.least("_cs", "usd")).alias("_po"))
    lends = seed_pool.join(pd.select("t", "pool", F.col("fam").alias("fc"), "usd"), ["t", "pool", "fc"]).groupBy("t", "fs", "fc").agg(
        F.sum(F.least("_cs", "usd")).alias("_pl"))
    keys = ["t", "fs", "fc"]
    out = rows
    for part in (lend_cs, lend_sc, in_vaults, overlap, lends):
        out = out.join(part, keys, "left")
    out = out.join(cand_total, ["t", "fc"], "left")
    zero = lambda c: F.when(F.col("fs") == F.col("fc"), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return out.select(
        *pairs.columns, (F.col("fs") == F.col("fc")).cast("int").alias("same_family"),
        F.log1p(zero("_cs")).alias("log_lend_cand_vs_seed"), F.log1p(zero("_sc")).alias("log_lend_seed_vs_cand"),
        F.log1p(zero("_vo")).alias("log_vault_overlap"),
        F.when(zero("_act") > 0, F.coalesce(F.try_divide(zero("_vs"), F.col("_act")), F.lit(0.0))).otherwise(0.0).alias("vault_share"),
        zero("_vn").cast("bigint").alias("shared_vaults"), F.log1p(zero("_po")).alias("log_pool_overlap"),
        F.log1p(zero("_pl")).alias("log_pool_lend_cand_vs_seed"))
