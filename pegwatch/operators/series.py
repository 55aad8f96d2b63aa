"""Hourly series: grids, bounded filling, as-of joins and the deviation from a reference value.

Everything here works on data already reduced to one row per (key, hour). A key then has at most as many rows as
there are hours in the calendar span, so a window over one key has a bound that the number of samples cannot move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions.scalars import nearest_hour
from pegwatch.rules import HOUR, Rules


def ordered(keys: Sequence[str], ts: str = "ts"):
    return Window.partitionBy(*keys).orderBy(ts)


def pick_samples(samples: DataFrame, tolerance: int | None = None, rank: Column | None = None) -> DataFrame:
    """The sample nearest each hour per (source, symbol); a better ranked key wins the hour outright."""
    hour = nearest_hour("ts", tolerance)
    rank = F.lit(0) if rank is None else rank
    order = F.struct(rank.alias("r"), F.abs(F.col("ts") - F.col("hour")).alias("d"), F.col("ts"), F.col("sample_id"))
    kept = [c for c in samples.columns if c not in ("source", "symbol")]
    return (
        samples.withColumn("hour", hour).filter("hour is not null")
        .groupBy("source", "symbol", "hour")
        .agg(F.min_by(F.struct(*kept), order).alias("s"))
        .select("source", "symbol", "hour", "s.*")
    )


def densify(df: DataFrame, keys: Sequence[str], ts: str = "ts", step: int = HOUR,
            first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every grid time from the first to the last row of each key (or between given bounds), new rows NULL.

    Rows must lie on the grid, one per key and time. Each row fills the gap up to its successor, so there is no spine
    to build and join, and the one shuffle on the keys also serves the windows that follow.
    """
    keys = list(keys)
    w = ordered(keys, ts)
    nxt, prev = F.lead(ts).over(w), F.lag(ts).over(w)
    until = F.coalesce(nxt - step, last if last is not None else F.col(ts))
    since = F.when(prev.isNull(), first).otherwise(F.col(ts)) if first is not None else F.col(ts)
    grid = F.sequence(since, until, F.lit(step).cast("bigint"))
    rest = [c for c in df.columns if c not in (*keys, ts)]
    own = F.col("_at") == F.col(ts)
    return df.withColumn("_grid", grid).withColumn("_at", F.explode("_grid")).select(
        *keys, F.col("_at").alias(ts), *[F.when(own, F.col(c)).alias(c) for c in rest])


def ffill(df: DataFrame, value: str, limit: int, keys: Sequence[str], ts: str = "ts", out: str | None = None) -> DataFrame:
    """Carries the last value over at most ``limit`` rows of a dense series."""
    frame = ordered(keys, ts).rowsBetween(-limit, 0)
    return df.withColumn(out or value, F.last(value, ignorenulls=True).over(frame))


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str], tolerance: int | None = None,
         ts: str = "ts") -> DataFrame:
    """Latest row of ``right`` at or before each row of ``left`` per key, at most ``tolerance`` seconds old."""
    keys, values = list(keys), list(values)
    payload = F.struct(*[F.col(c) for c in left.columns if c not in (*keys, ts)])
    record = F.struct(F.col(ts).alias("_at"), *[F.col(v) for v in values])
    lhs = left.select(*keys, ts, F.lit(1).alias("_side"), payload.alias("_l"))
    rhs = right.select(*keys, ts, F.lit(0).alias("_side"), record.alias("_r"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    frame = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_m", F.last("_r", ignorenulls=True).over(frame)).filter("_side = 1")
    fresh = F.lit(True) if tolerance is None else (F.col(ts) - F.col("_m._at") <= tolerance)
    return hit.select(
        *keys, ts, "_l.*", *[F.when(fresh, F.col(f"_m.{v}")).alias(v) for v in values],
        F.when(fresh, F.col("_m._at")).alias(f"{ts}_matched"),
    )


def asof_grid(obs: DataFrame, by: Sequence[str], max_stale: int, start: int, step: int, end: Column | int,
              avail: str = "avail_ts", rank: Sequence[str] = ()) -> DataFrame:
    """Each observation on every grid time it holds for: from its availability until the next one of its key
    becomes available or it is older than ``max_stale``. No join: the interval is expanded to its grid times. ``rank``: of several
    observations of a key at one time only the greatest by these columns counts; the sort that finds the next one finds it too."""
    by = list(by)
    last = F.lit(end) if isinstance(end, int) else end
    nxt = F.lead(avail).over(Window.partitionBy(*by).orderBy(avail, *rank))
    if rank:
        obs = obs.withColumn("_next", nxt).filter(~F.coalesce(F.col("_next") == F.col(avail), F.lit(False)))
        nxt = F.col("_next")
    until = F.least(nxt - 1, F.col(avail) + max_stale, last)
    first_grid = F.ceil((F.col(avail) - start) / step) * step + start
    last_grid = F.floor((until - start) / step) * step + start
    grid = F.when(first_grid <= last_grid,
                  F.sequence(first_grid.cast("bigint"), last_grid.cast("bigint"), F.lit(step).cast("bigint")))
    return obs.withColumn("_grid", grid).withColumn("t", F.explode("_grid")).drop("_grid", "_next", avail)


def price_lookup(rows: DataFrame, prices: DataFrame, keys: Sequence[str] = ("symbol",), tolerance: int = 6 * HOUR,
                 ts: str = "ts") -> DataFrame:
    """Market price at or before each row, NULL if the latest one is older than the tolerance."""
    return asof(rows, prices.select(*keys, F.col("ts").alias(ts), F.col("price").alias("market_price")),
                ["market_price"], keys, tolerance, ts).drop(f"{ts}_matched")


def interp_ratio(prices: DataFrame, base: DataFrame, reach: int = 2 * HOUR) -> DataFrame:
    """Price over the base price interpolated linearly at the sample's own time.

    ``base`` has at most one sample per (source, hour). Its neighbours are gathered once per base hour, so the many
    asset samples only need an equality join on the hour. Needs an exact hit or neighbours within ``reach`` on both
    sides.
    """
    points = base.select("source", "hour", F.struct(F.col("ts").alias("at"), F.col("price").alias("px")).alias("p"))
    span = reach // HOUR + 2
    around = points.select(
        "source", "p", F.explode(F.transform(F.sequence(F.lit(-span), F.lit(span)),
                                             lambda i: F.col("hour") + i * HOUR)).alias("hour"),
    ).groupBy("source", "hour").agg(F.sort_array(F.collect_list("p")).alias("near"))
    right = F.array_min(F.filter("near", lambda p: p["at"] >= F.col("ts")))
    left = F.array_max(F.filter("near", lambda p: p["at"] < F.col("ts")))
    joined = prices.join(around, ["source", "hour"]).withColumn("_r", right).withColumn("_l", left)
    close = (F.col("ts") - F.col("_l.at") <= reach) & (F.col("_r.at") - F.col("ts") <= reach)
    share = F.try_divide(F.col("ts") - F.col("_l.at"), F.col("_r.at") - F.col("_l.at"))
    level = F.when(F.col("_r.at") == F.col("ts"), F.col("_r.px")).when(
        close, F.col("_l.px") + share * (F.col("_r.px") - F.col("_l.px")))
    return joined.withColumn("base_price", level).filter("base_price is not null").withColumn(
        "ratio", F.try_divide("price", "base_price")).drop("near", "_r", "_l")


def aligned_ratio(prices: DataFrame, base: DataFrame, gap: int) -> DataFrame:
    """Ratio on whole hours after bounded filling of both series, for prices without sample times."""
    keys = ["source", "symbol"]

    def filled(df: DataFrame) -> DataFrame:
        return ffill(densify(df.select(*keys, F.col("hour").alias("ts"), "price"), keys), "price", gap, keys)

    right = filled(base).select("source", "ts", F.col("price").alias("base_price"))
    return filled(prices).join(right, ["source", "ts"]).filter("price is not null and base_price is not null").withColumn(
        "ratio", F.try_divide("price", "base_price"))


def own_values(prices: DataFrame, registry: DataFrame, base_symbol: str) -> DataFrame:
    """One value per (source, symbol, hour) with a sample of its own: the price, or for an ETH peg quoted in USD
    its ratio to the base asset."""
    tagged = prices.join(registry.select("symbol", "peg"), "symbol")
    in_eth = (F.col("peg") == "ETH") & (F.col("unit") != "ETH")
    plain = tagged.filter(~in_eth).select("source", "symbol", F.col("hour").alias("ts"), F.col("price").alias("own"))
    ratio = interp_ratio(tagged.filter(in_eth), prices.filter(F.col("symbol") == base_symbol))
    return plain.unionByName(ratio.select("source", "symbol", F.col("hour").alias("ts"), F.col("ratio").alias("own")))


def trailing_median(value: str, hours: int, least: int, keys: Sequence[str]) -> Column:
    """Median of the previous ``hours`` rows, the current one excluded, from at least ``least`` values. A frame holds
    at most ``hours`` numbers, so sorting them as an array beats an aggregate that counts values in a hash map."""
    frame = ordered(keys).rowsBetween(-hours, -1)
    held = F.sort_array(F.collect_list(value).over(frame))

    def middle(a: Column) -> Column:
        n = F.size(a)
        low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
        return F.when(n >= least, low + (high - low) / 2)

    # inside transform the sorted array is bound once, so it is not sorted again for each use
    return F.get(F.transform(F.array(held), middle), 0)


def deviation(prices: DataFrame, rates: DataFrame, registry: DataFrame, rules: Rules, base_symbol: str) -> DataFrame:
    """Hourly deviation of every (source, symbol) from its reference value.

    ``registry`` carries symbol, peg, kind and value. Kinds: fixed, eth_parity, rate (as-of, falling back to the
    trailing median) and trailing_median. Rows: value carried over short gaps, ``obs`` marks own samples.
    """
    keys = ["source", "symbol"]
    own = own_values(prices, registry, base_symbol)
    dense = densify(own, keys).withColumn("obs", F.col("own").isNotNull())
    filled = ffill(dense, "own", rules.gap_fill, keys, out="value")
    filled = filled.withColumn("trailing", trailing_median("value", rules.trailing_hours, rules.trailing_min, keys))
    meta = registry.select("symbol", "peg", "category", "kind", F.col("value").alias("fixed_value"))
    tagged = filled.join(meta, "symbol")
    used = registry.filter("kind = 'rate'").select("symbol")
    readings = valid_rates(rates, rules).join(used, "symbol", "left_semi")
    rated = asof(tagged, readings, ["rate"], ["symbol"], rules.rate_fill_hours * HOUR)
    ref = (
        F.when(F.col("kind") == "fixed", F.coalesce("fixed_value", F.lit(1.0)))
        .when(F.col("kind") == "eth_parity", F.lit(1.0))
        .when(F.col("kind") == "rate", F.coalesce("rate", "trailing"))
        .otherwise(F.col("trailing"))
    )
    theta = F.when(F.col("peg") == "ETH", rules.theta_eth).otherwise(rules.theta_usd)
    return rated.withColumn("ref", ref).select(
        "source", "symbol", "category", "peg", "kind", "ts", "value", "ref", "obs",
        (F.try_divide("value", "ref") - 1.0).alias("dev"), theta.alias("theta"),
    )


def valid_rates(rates: DataFrame, rules: Rules) -> DataFrame:
    """Readings that succeeded and lie in the plausible range."""
    return rates.filter((F.col("ok") == 1) & F.col("rate").between(rules.rate_low, rules.rate_high)).select(
        "symbol", "ts", "rate")


def choose_source(dev: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keeps, per symbol, the first source in ``order`` that has any deviation."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    best = F.min(F.when(F.col("dev").isNotNull(), rank)).over(Window.partitionBy("symbol"))
    return dev.withColumn("_rank", rank).withColumn("_best", best).filter("_rank = _best").drop("_rank", "_best")


def observed_only(dev: DataFrame) -> DataFrame:
    """Deviation at hours with a sample of their own; tables without the flag count every hour."""
    if "obs" not in dev.columns:
        return dev.withColumn("dev_obs", F.col("dev"))
    return dev.withColumn("dev_obs", F.when(F.col("obs").cast("int") == 1, F.col("dev")))
