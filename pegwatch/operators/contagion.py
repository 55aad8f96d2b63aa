"""The pair table of the contagion task: what is known at the decision hour about a seed, a candidate and their links.

Features are computed for the asked (asset, hour) rows only. Hourly values are kept as one array per asset and day; an asked row
meets the few days of its look-back, not every hour of it, and its trail (one array of the last hours, NULL where no value is known)
is the only input of the rolling features and of the pair correlations. A trail ends at the asked hour, so nothing later is seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegwatch.operators.series import asof
from pegwatch.operators.tables import running_count
from pegwatch.rules import DAY, HOUR

NEAR = -0.5
# The column groups of the model ladder.
OWN = ("z_now", "z_min_24h", "z_min_168h", "z_std_168h", "near_frac_24h", "near_miss_168h", "hours_since_near_miss", "episodes_90d", "episodes_365d",
       "hours_since_episode", "peg_eth", "und_z_now", "missing_frac_24h", "follow_rate")
SIM = ("same_category", "same_peg", "dev_corr_30d", "codepeg_share")
FAM = ("same_family",)
GRAPH = ("log_lend_cand_vs_seed", "log_lend_seed_vs_cand", "log_vault_overlap", "vault_share", "shared_vaults", "log_pool_overlap", "log_pool_lend_cand_vs_seed")
LADDER = {"logit_own": OWN, "logit_sim": OWN + SIM, "logit_fam": OWN + SIM + FAM, "logit_graph": OWN + SIM + FAM + GRAPH}


def day_lines(known: DataFrame) -> DataFrame:
    """symbol, day, line: the 24 hourly values of a day."""
    hour = F.floor(F.col("ts") % DAY / HOUR)
    line = F.array(*[F.max(F.when(hour == k, F.col("z"))) for k in range(24)])
    return known.groupBy("symbol", F.floor(F.col("ts") / DAY).alias("day")).agg(line.alias("line"))


def trails(asks: DataFrame, lines: DataFrame, hours: int) -> DataFrame:
    """symbol, ts, trail: the values of the ``hours`` hours up to each asked hour, oldest first."""
    asks = asks.select("symbol", "ts").distinct()
    first = F.floor((F.col("ts") - (hours - 1) * HOUR) / DAY)
    days = asks.select("symbol", "ts", F.explode(F.sequence(first, F.floor(F.col("ts") / DAY))).alias("day"))
    blank = F.array_repeat(F.lit(None).cast("double"), 24)
    met = days.join(lines, ["symbol", "day"], "left").select("symbol", "ts", F.struct("day", F.coalesce("line", blank).alias("line")).alias("d"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["line"]))
    skipped = F.floor(F.pmod(F.col("ts") - (hours - 1) * HOUR, F.lit(DAY)) / HOUR).cast("int")
    return met.groupBy("symbol", "ts").agg(joined.alias("_all")).select("symbol", "ts", F.slice("_all", skipped + 1, F.lit(hours)).alias("trail"))


def _known(trail: Column, hours: int) -> Column:
    return F.filter(F.slice(trail, -hours, hours), lambda x: x.isNotNull())


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _deviation(values: Column, least: int) -> Column:
    """Sample standard deviation, NULL below ``least`` values."""
    n = F.size(values)
    squares = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), _mean(values).alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")))
    return F.when(n >= least, F.sqrt(squares["s"] / (n - 1)))


def own_features(asks: DataFrame, z: DataFrame, eps: DataFrame, registry: DataFrame, wrappers: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The price features of the asked (symbol, ts) rows; ``z`` holds threshold units (symbol, ts, z)."""
    asks = asks.select("symbol", "ts").distinct()
    known = z.where("z is not null").select("symbol", "ts", "z")
    first = z.agg(F.min("ts")).scalar()
    week = trails(asks, day_lines(known) if lines is None else lines, 168)
    near = lambda v: F.filter(v, lambda x: x < NEAR)
    day, whole = _known(F.col("trail"), 24), _known(F.col("trail"), 168)
    rolled = week.select(
        "symbol", "ts", F.element_at("trail", -1).alias("z_now"), F.array_min(day).alias("z_min_24h"), F.array_min(whole).alias("z_min_168h"),
        _deviation(whole, 6).alias("z_std_168h"), F.when(F.size(day) > 0, F.size(near(day)) / F.size(day)).alias("near_frac_24h"),
        F.when(F.size(whole) > 0, F.size(near(whole)).cast("double")).alias("near_miss_168h"),
        (1 - F.size(day) / F.least(F.lit(24), (F.col("ts") - first) / HOUR + 1)).alias("missing_frac_24h"))

    def since(events: DataFrame, name: str, cap: int) -> DataFrame:
        last = asof(asks, events.select("symbol", "ts", F.col("ts").alias("_last")), ["_last"], ["symbol"])
        return last.select("symbol", "ts", F.when(F.col("_last").isNotNull(), F.least((F.col("ts") - F.col("_last")) / HOUR, F.lit(float(cap)))).alias(name))

    known_at = eps.select("symbol", F.col("tk").alias("ts")).distinct()
    counts = running_count(eps, ["symbol"], "tk")

    def episodes(days: int) -> DataFrame:
        upto = asof(asks, counts, ["cum"], ["symbol"]).select("symbol", "ts", F.coalesce("cum", F.lit(0)).alias("_to"))
        back = asof(asks.select("symbol", (F.col("ts") - days * DAY).alias("ts")), counts, ["cum"], ["symbol"])
        back = back.select("symbol", (F.col("ts") + days * DAY).alias("ts"), F.coalesce("cum", F.lit(0)).alias("_from"))
        return upto.join(back, ["symbol", "ts"]).select("symbol", "ts", (F.col("_to") - F.col("_from")).alias(f"episodes_{days}d"))

    under = wrappers.select(F.col("wrapper").alias("symbol"), "underlying").join(asks, "symbol").select("symbol", "ts", "underlying")
    under = under.join(known.select(F.col("symbol").alias("underlying"), "ts", F.col("z").alias("und_z_now")), ["underlying", "ts"]).drop("underlying")
    out = rolled.join(registry.select("symbol", (F.col("peg") == "ETH").cast("double").alias("peg_eth")), "symbol", "left")
    for part in (since(known.where(F.col("z") < NEAR), "hours_since_near_miss", 24 * 90), since(known_at, "hours_since_episode", 24 * 365), episodes(90), episodes(365), under):
        out = out.join(part, ["symbol", "ts"], "left")
    return out


def pair_correlation(pairs: DataFrame, lines: DataFrame, hours: int = 720, least: int = 240) -> DataFrame:
    """Each pair with ``dev_corr_30d``: the correlation of the joint known hours of both trails up to tau."""
    asked = pairs.select("seed", "cand", "tau").distinct()
    sides = asked.select(F.col("seed").alias("symbol"), F.col("tau").alias("ts")).unionByName(asked.select(F.col("cand").alias("symbol"), F.col("tau").alias("ts")))
    every = trails(sides, lines, hours)
    side = lambda key, name: every.select(F.col("symbol").alias(key), F.col("ts").alias("tau"), F.col("trail").alias(name))
    both = asked.join(side("seed", "_x"), ["seed", "tau"]).join(side("cand", "_y"), ["cand", "tau"])
    joint = F.filter(F.arrays_zip("_x", "_y"), lambda p: p["_x"].isNotNull() & p["_y"].isNotNull())
    both = both.select("seed", "cand", "tau", joint.alias("_p")).where(F.size("_p") >= least)
    xs, ys = F.transform("_p", lambda p: p["_x"]), F.transform("_p", lambda p: p["_y"])
    both = both.where((F.array_min(xs) < F.array_max(xs)) & (F.array_min(ys) < F.array_max(ys))).withColumn("_mx", _mean(xs)).withColumn("_my", _mean(ys))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("xx", "yy", "xy")])

    def add(a: Column, p: Column) -> Column:
        x, y = p["_x"] - F.col("_mx"), p["_y"] - F.col("_my")
        return F.struct((a["xx"] + x * x).alias("xx"), (a["yy"] + y * y).alias("yy"), (a["xy"] + x * y).alias("xy"))

    sums = both.withColumn("_s", F.aggregate("_p", zero, add))
    corr = sums.select("seed", "cand", "tau", F.try_divide("_s.xy", F.sqrt("_s.xx") * F.sqrt("_s.yy")).alias("dev_corr_30d"))
    return pairs.join(corr, ["seed", "cand", "tau"], "left")


def contagion_table(pairs: DataFrame, follow: DataFrame, correlated: DataFrame, links: DataFrame, own: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each pair with its labels and the four feature groups. ``follow`` and ``correlated`` hold a row per pair, ``links`` one
    per (seed_id, cand), ``own`` one per asked (symbol, ts)."""
    asset = lambda key, tag: registry.select(F.col("symbol").alias(key), F.col("category").alias(f"_{tag}c"), F.col("peg").alias(f"_{tag}p"))
    rows = pairs.select("seed_id", "seed", "tau", "cluster", "split", "seed_severity", "cand", "y72", "y168")
    rows = rows.join(asset("seed", "s"), "seed").join(asset("cand", "k"), "cand")
    rows = rows.withColumn("same_category", (F.col("_sc") == F.col("_kc")).cast("double")).withColumn("same_peg", (F.col("_sp") == F.col("_kp")).cast("double")).drop("_sc", "_kc", "_sp", "_kp")
    rows = rows.join(correlated.select("seed_id", "cand", "dev_corr_30d"), ["seed_id", "cand"]).join(follow.select("seed_id", "cand", "follow_rate", "codepeg_share"), ["seed_id", "cand"])
    rows = rows.join(links.select("seed_id", "cand", *FAM, *GRAPH), ["seed_id", "cand"])
    mine = own.withColumnsRenamed({"symbol": "cand", "ts": "tau"}).select("cand", "tau", *(c for c in OWN if c != "follow_rate"))
    return rows.join(mine, ["cand", "tau"])


def group_summary(table: DataFrame) -> DataFrame:
    """Seeds, clusters, pairs and followers on each side of the split."""
    return table.groupBy("split").agg(
        F.count_distinct("seed_id").alias("seeds"), F.count_distinct("cluster").alias("clusters"), F.count("*").alias("pairs"),
        F.sum("y72").alias("y72"), F.sum("y168").alias("y168"), F.sum((F.col("same_family") > 0).cast("int")).alias("same_family"))


def linked_pairs(table: DataFrame, sources: dict[str, Sequence[str]]) -> DataFrame:
    """Pairs with any link of a source, and those of them that were followed within a week."""
    any_of = {name: F.greatest(*[(F.col(c) > 0).cast("int") for c in cols], F.lit(0)) for name, cols in sources.items()}
    long = table.select("y168", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), x.alias("linked")) for n, x in any_of.items()])).alias("s")).select("y168", "s.*")
    return long.groupBy("source").agg(F.sum("linked").alias("pairs"), F.coalesce(F.sum(F.when(F.col("linked") == 1, F.col("y168"))), F.lit(0)).alias("followed"))


def rankers(table: DataFrame) -> DataFrame:
    """The fixed rankers of every pair: usual suspects, present stress and past following."""
    return table.select("*", F.coalesce(F.col("episodes_365d").cast("double"), F.lit(0.0)).alias("hist"), (-F.coalesce("z_min_24h", F.lit(0.0))).alias("stress"), F.col("follow_rate").alias("follow"))
