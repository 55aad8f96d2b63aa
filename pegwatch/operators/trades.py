"""Token transfers to trades to hourly trade prices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.functions.ranks import exact_quantiles
from pegwatch.functions.scalars import iso_hour
from pegwatch.rules import HOUR, ZERO_ADDRESS


def hour_of(ts: str = "ts"):
    return (F.floor(F.col(ts) / HOUR) * HOUR).cast("bigint")


def first_block_per_hour(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(hour_of().alias("hour")).agg(F.min("block_number").alias("block_number"))


def token_dimension(assets: DataFrame, quotes: DataFrame, onchain: DataFrame, meta: DataFrame) -> DataFrame:
    """Role, peg and decimals of every token; decimals come from the chain, else from the price metadata.
    ``missing`` marks tokens that have neither, which callers must treat as an error."""
    both = assets.withColumn("role", F.lit("asset")).unionByName(quotes.withColumn("role", F.lit("quote")))
    return (
        both.join(onchain.select("address", F.col("decimals").alias("_chain")), "address", "left")
        .join(meta.select("address", F.col("decimals").alias("_meta")), "address", "left")
        .select("address", "symbol", "role", F.coalesce("_chain", "_meta").alias("decimals"), "peg",
                F.coalesce("_chain", "_meta").isNull().alias("missing"))
    )


def require_decimals(tokens: DataFrame) -> DataFrame:
    """The dimension with an assertion in the plan: the job that reads a token without decimals fails, naming it. No pass of its own."""
    lacking = F.raise_error(F.concat(F.lit("no decimals for token "), F.coalesce("symbol", "address", F.lit("?"))))
    return tokens.withColumn("decimals", F.coalesce("decimals", lacking.cast("int"))).drop("missing")


def priced_transfers(transfers: DataFrame, tokens: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Transfers of listed tokens in the time range, no mints or burns, with a readable amount."""
    zero = F.lit(ZERO_ADDRESS)
    out = transfers.filter((F.col("from_address") != zero) & (F.col("to_address") != zero))
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    if end is not None:
        out = out.filter(F.col("ts") < end)
    out = out.withColumn("amount_raw", F.expr("try_cast(quantity as double)")).filter("amount_raw is not null")
    return out.join(tokens.select("address"), "address", "left_semi")


def pair_trades(transfers: DataFrame, tokens: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """Parties that received exactly one token and paid exactly one other in a transaction, as (asset, quote).

    Every transfer is an entry in two accounts. A party's account has a line for each token with what came in and what
    went out; a swap is an account of two lines, one of an asset and one of a quote, one only in and one only out.
    Accounts lie inside a block, so transfers that are dealt by block are not moved again, here or in ``dedupe_trades``.
    """
    account = ["block_number", "transaction_index", "party"]
    came = F.struct(F.col("to_address").alias("party"), F.col("amount_raw").alias("came"), F.lit(None).cast("double").alias("went"))
    went = F.struct(F.col("from_address").alias("party"), F.lit(None).cast("double").alias("came"), F.col("amount_raw").alias("went"))
    entries = transfers.select("block_number", "transaction_index", "ts", "address", F.explode(F.array(came, went)).alias("e")).select(
        "block_number", "transaction_index", "ts", "address", "e.*")
    lines = entries.groupBy(*account, "address").agg(
        F.min("ts").alias("ts"), F.sum("came").alias("came"), F.sum("went").alias("went"))
    unit = F.pow(F.lit(10.0), F.col("decimals"))
    lines = lines.join(tokens.select("address", "symbol", "role", "decimals", "peg"), "address").withColumn("amount", F.coalesce("came", "went") / unit)
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    swaps = lines.groupBy(*account).agg(
        F.min("ts").alias("ts"), F.count("*").alias("_lines"), F.count("came").alias("_in"), F.count("went").alias("_out"),
        F.count(F.when(F.coalesce("came", "went") > 0, 1)).alias("_some"), (F.min("role") != F.max("role")).alias("_roles"),
        of("asset", "symbol").alias("symbol"), of("asset", "peg").alias("peg"), of("quote", "symbol").alias("quote"), of("quote", "peg").alias("quote_peg"),
        of("asset", "amount").alias("asset_amount"), of("quote", "amount").alias("quote_amount"),
    ).filter("_lines = 2 and _in = 1 and _out = 1 and _some = 2 and _roles")
    floor = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))])
    return swaps.filter((F.col("peg") == F.col("quote_peg")) & (F.col("quote_amount") >= F.try_element_at(floor, F.col("quote_peg")))).select(
        "block_number", "transaction_index", "ts", "party", "symbol", "peg", "quote", "quote_peg", "asset_amount", "quote_amount")


def dedupe_trades(swaps: DataFrame) -> DataFrame:
    """One row per (transaction, asset, quote): both ends of a swap report it. A party occurs once per transaction
    in the input, so counting rows counts parties."""
    return swaps.groupBy("block_number", "transaction_index", "symbol", "peg", "quote").agg(
        F.min("ts").alias("ts"), F.max("asset_amount").alias("asset_amount"),
        F.max("quote_amount").alias("quote_amount"), F.count("*").alias("n_parties"))


def hourly_prices(trades: DataFrame, minimums: Mapping[str, float]) -> DataFrame:
    """Count, volume, volume-weighted price and exact quartiles per (asset, quote, hour). The quartiles split a hot
    hour over value buckets instead of holding all of its prices in one task."""
    least = F.create_map(*[x for k, v in minimums.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = trades.filter((F.col("quote_amount") >= F.try_element_at(least, F.col("peg"))) & (F.col("asset_amount") > 0)).select(
        "symbol", "quote", "peg", hour_of().alias("ts"), "n_parties", "quote_amount", "asset_amount",
        (F.col("quote_amount") / F.col("asset_amount")).alias("price"))
    keys = ["symbol", "quote", "ts"]
    stats = rows.groupBy(*keys).agg(
        F.min("peg").alias("unit"), F.count("*").alias("n_trades"), F.sum("n_parties").alias("n_parties"),
        F.round(F.sum("quote_amount"), 2).alias("volume_quote"),
        (F.sum("quote_amount") / F.sum("asset_amount")).alias("vwap"))
    quartiles = exact_quantiles(rows, "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys)
    return stats.join(quartiles, keys).withColumn("hour", iso_hour("ts")).withColumn("source", F.lit("trades"))


SKETCH_SIZE = 400  # of a quantile sketch: rank error about 0.7 percent at 99 percent confidence, exact up to as many values


def price_sketches(trades: DataFrame, minimums: Mapping[str, float], size: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable quantile sketch of the trade prices per (asset, quote, hour), bounded in size, combined map-side: the approximate
    form of ``hourly_prices`` without ranges of values."""
    least = F.create_map(*[x for k, v in minimums.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = trades.filter((F.col("quote_amount") >= F.try_element_at(least, F.col("peg"))) & (F.col("asset_amount") > 0))
    price = F.col("quote_amount") / F.col("asset_amount")
    return rows.groupBy("symbol", "quote", hour_of().alias("ts")).agg(F.kll_sketch_agg_double(price, size).alias("sketch"))


def merged_quartiles(sketches: DataFrame, step: int = 24 * HOUR) -> DataFrame:
    """Hourly sketches merged to longer spans without the trades: count and quartiles per (asset, quote, span)."""
    span = (F.floor(F.col("ts") / step) * step).cast("bigint")
    merged = sketches.groupBy("symbol", "quote", span.alias("ts")).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    q = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return merged.select("symbol", "quote", "ts", F.kll_sketch_get_n_double("sketch").alias("n_trades"), *q)


def collapse_quotes(hourly: DataFrame) -> DataFrame:
    """One price per asset-hour: the median across quote tokens of the hourly medians and upper quartiles. Tables
    that already have one price per asset-hour pass through with high = price."""
    if "quote" not in hourly.columns or "p50" not in hourly.columns:
        return hourly if "high" in hourly.columns else hourly.withColumn("high", F.col("price"))
    return hourly.groupBy("symbol", "ts").agg(
        F.percentile("p50", 0.5).alias("price"), F.percentile("p75", 0.5).alias("high"), F.min("unit").alias("unit"),
        F.sum("n_trades").alias("n_trades"), F.count_distinct("quote").alias("n_quotes"),
        F.sum("volume_quote").alias("volume_quote"))
