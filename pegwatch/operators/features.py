"""Leak-free features of asset-hours. All windows look back over dense hourly (or daily) series.

Windows are per asset over one row per hour. Market-wide windows run over a table with one row per calendar hour,
built by an aggregation first; that table is the only thing an unpartitioned window ever sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.operators.series import asof, densify, ordered
from pegwatch.rules import DAY, HOUR, Rules


def back(n: int, keys: Sequence[str] = ("symbol",)):
    """The last n rows, the current one included."""
    return ordered(keys).rowsBetween(-(n - 1), 0)


def z_table(dev: DataFrame) -> DataFrame:
    """Threshold units on the hour range of the whole table, one row per asset and hour."""
    first, last = dev.agg(F.min("ts")).scalar(), dev.agg(F.max("ts")).scalar()
    dense = densify(dev.select("symbol", "ts", "dev", "theta"), ["symbol"], first=first, last=last)
    return dense.select("symbol", "ts", S.threshold_units("dev", "theta").alias("z"))


def since(flag, cap: float, unit: int = HOUR, keys: Sequence[str] = ("symbol",)):
    """Time units since the flag was last true, capped; NULL before the first."""
    last = F.last(F.when(flag, F.col("ts")), True).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(last.isNotNull(), F.least((F.col("ts") - last) / unit, F.lit(float(cap))))


def rolling(z: DataFrame) -> DataFrame:
    """Minima, maxima, means, deviations, changes and near-miss counters of the threshold units."""
    x = F.col("z")
    near = F.when(x.isNotNull(), (x < -0.5).cast("double"))
    out = [x.alias("z_now")]
    out += [F.min("z").over(back(w)).alias(f"z_min_{w}h") for w in (6, 24, 72, 168)]
    out.append(F.max("z").over(back(24)).alias("z_max_24h"))
    for w in (24, 168):
        out.append(F.avg("z").over(back(w)).alias(f"z_mean_{w}h"))
        out.append(F.when(F.count("z").over(back(w)) >= 6, F.stddev_samp("z").over(back(w))).alias(f"z_std_{w}h"))
    out += [(x - F.lag("z", k).over(ordered(["symbol"]))).alias(f"z_chg_{k}h") for k in (1, 6, 24)]
    out.append((x - F.avg("z").over(back(168))).alias("z_vs_mean_168h"))
    out.append(F.sum(near).over(back(168)).alias("near_miss_168h"))
    out.append(F.avg(near).over(back(24)).alias("near_frac_24h"))
    out.append(since(x < -0.5, 24 * 90).alias("hours_since_near_miss"))
    out.append(F.avg(x.isNull().cast("double")).over(back(24)).alias("missing_frac_24h"))
    return z.select("symbol", "ts", *out)


def known_counts(eps: DataFrame) -> DataFrame:
    return eps.groupBy("symbol", F.col("tk").alias("ts")).agg(F.count("*").alias("_known"))


def history(eps: DataFrame, spine: DataFrame) -> DataFrame:
    """Episodes known in the last 30, 90 and 365 days and hours since the last one."""
    rows = spine.select("symbol", "ts").join(known_counts(eps), ["symbol", "ts"], "left")
    n = F.coalesce("_known", F.lit(0))
    counts = [F.sum(n).over(back(24 * d)).alias(f"episodes_{d}d") for d in (30, 90, 365)]
    return rows.select("symbol", "ts", *counts, since(n > 0, 24 * 365).alias("hours_since_episode"))


def market(z: DataFrame, eps: DataFrame, base: DataFrame, usd: DataFrame) -> DataFrame:
    """Cross-section stress, recent episodes anywhere and the base asset's returns, one row per hour."""
    tagged = z.join(usd.select("symbol", F.lit(True).alias("_usd")), "symbol", "left")
    cross = tagged.groupBy("ts").agg(
        (F.count(F.when(F.col("z") < -0.5, 1)) / F.nullif(F.count("z"), F.lit(0))).alias("mkt_stress_frac"),
        F.avg(F.when(F.col("_usd"), S.clip("z", -5.0, 5.0))).alias("mkt_mean_z_usd"))
    known = eps.groupBy(F.col("tk").alias("ts")).agg(F.count("*").alias("_n"))
    hours = asof(cross.join(known, "ts", "left"), base.select("ts", "price"), ["price"], [], 2 * HOUR)
    w = Window.orderBy("ts")
    n, lp = F.coalesce("_n", F.lit(0)), F.log("price")
    step = lp - F.lag(lp, 1).over(w)
    out = hours.withColumn("_step", step)
    vol = w.rowsBetween(-23, 0)
    return out.select(
        "ts", "mkt_stress_frac", "mkt_mean_z_usd",
        F.sum(n).over(w.rowsBetween(-23, 0)).alias("mkt_episodes_24h"),
        F.sum(n).over(w.rowsBetween(-167, 0)).alias("mkt_episodes_168h"),
        *[(lp - F.lag(lp, k).over(w)).alias(f"eth_ret_{k}h") for k in (1, 24, 168)],
        F.when(F.count("_step").over(vol) >= 12, F.stddev_samp("_step").over(vol)).alias("eth_vol_24h"))


def wrapped(rows: DataFrame, pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each wrapper sees its underlying's series, under the prefix ``und_``."""
    under = rows.select(F.col("symbol").alias("underlying"), "ts", *[F.col(c).alias(f"und_{c}") for c in cols])
    return pairs.select(F.col("wrapper").alias("symbol"), "underlying").join(under, "underlying").drop("underlying")


def one_hot(column: str, values: Sequence[str], prefix: str) -> list:
    return [(F.col(column) == v).cast("double").alias(f"{prefix}{v}") for v in values]


def exposure(table: DataFrame, usd: Sequence[str], changes: Sequence[str], raw: Sequence[str] = ()) -> DataFrame:
    """Log levels, raw measures, log changes over 24, 72 and 168 rows, guarded ratios and the exposure flag."""
    w = ordered(["symbol"])
    logs = table.select("*", *[S.log_level(c).alias(f"log_{c}") for c in usd])
    out = [F.col(f"log_{c}") for c in usd] + [F.col(c) for c in raw]
    out += [(F.col(f"log_{c}") - F.lag(f"log_{c}", k).over(w)).alias(f"dlog_{c}_{k}h") for c in changes for k in (24, 72, 168)]
    out.append(S.guarded_ratio("mm_borrow_against_usd", "mm_collateral_usd").alias("borrow_to_collateral"))
    out.append(S.guarded_ratio("family_borrow_against_usd", "family_collateral_usd").alias("family_borrow_to_collateral"))
    has = F.lit(False)
    for c in ("family_collateral_usd", "mm_supply_usd", "aave_supply_usd"):
        has = has | (F.coalesce(F.col(f"log_{c}"), F.lit(0.0)) > 0)
    return logs.select("symbol", "ts", *out, has.cast("double").alias("has_exposure"))


def time_split(ts, rules: Rules):
    return F.when(S.col(ts) <= rules.train_end, "train").when(S.col(ts) <= rules.valid_end, "valid").otherwise("test")


def onset_table(labels: DataFrame, roll: DataFrame, hist: DataFrame, mkt: DataFrame, und: DataFrame, expo: DataFrame,
                categories: Sequence[str], rules: Rules) -> DataFrame:
    """Labelled asset-hours with every feature group and the time split."""
    rows = labels.filter("y24 is not null or y72 is not null").select(
        "symbol", "ts", "y24", "y72", "in_episode", (F.col("peg") == "ETH").cast("double").alias("peg_eth"),
        *one_hot("category", categories, "cat_"))
    return (
        rows.join(roll, ["symbol", "ts"], "left").join(hist, ["symbol", "ts"], "left").join(mkt, "ts", "left")
        .join(und, ["symbol", "ts"], "left").join(expo, ["symbol", "ts"], "left")
        .withColumn("has_exposure", F.coalesce("has_exposure", F.lit(0.0))).withColumn("split", time_split("ts", rules))
    )


def split_summary(table: DataFrame, y: str) -> DataFrame:
    return table.groupBy("split").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col(y) == 1, 1)).alias("positives"), F.count_distinct("symbol").alias("assets"))


def daily_closes(dev: DataFrame) -> DataFrame:
    """Deviation at 00:00 UTC on a complete daily index, in threshold units."""
    first = dev.agg((F.ceil(F.min("ts") / DAY) * DAY).cast("bigint")).scalar()
    last = dev.agg((F.floor(F.max("ts") / DAY) * DAY).cast("bigint")).scalar()
    closes = dev.filter(F.col("ts") % DAY == 0).select("symbol", "ts", "dev", "theta")
    dense = densify(closes, ["symbol"], step=DAY, first=first, last=last)
    return dense.select("symbol", "ts", S.threshold_units("dev", "theta").alias("z"))


def daily(z: DataFrame) -> DataFrame:
    """The daily counterpart of the rolling features."""
    x = F.col("z")
    near = F.when(x.isNotNull(), (x < -0.5).cast("double"))
    beyond = F.when(x.isNotNull(), (x <= -1).cast("double"))
    out = [x.alias("dz_now")]
    out += [F.min("z").over(back(w)).alias(f"dz_min_{w}d") for w in (3, 7, 30)]
    out.append(F.max("z").over(back(7)).alias("dz_max_7d"))
    for w in (7, 30):
        out.append(F.avg("z").over(back(w)).alias(f"dz_mean_{w}d"))
        out.append(F.when(F.count("z").over(back(w)) >= 3, F.stddev_samp("z").over(back(w))).alias(f"dz_std_{w}d"))
    out += [(x - F.lag("z", k).over(ordered(["symbol"]))).alias(f"dz_chg_{k}d") for k in (1, 7)]
    out.append((x - F.avg("z").over(back(30))).alias("dz_vs_mean_30d"))
    out.append(F.sum(near).over(back(30)).alias("d_near_30d"))
    out += [F.sum(beyond).over(back(w)).alias(f"d_beyond_{w}d") for w in (30, 90, 365)]
    out.append(since(x < -0.5, 365, DAY).alias("d_days_since_near"))
    out.append(since(x <= -1, 365, DAY).alias("d_days_since_beyond"))
    out.append(F.avg(x.isNull().cast("double")).over(back(7)).alias("d_missing_frac_7d"))
    return z.select("symbol", "ts", *out)


def daily_market(z: DataFrame, base: DataFrame, usd: DataFrame) -> DataFrame:
    """Daily cross-section and base returns, one row per day."""
    tagged = z.join(usd.select("symbol", F.lit(True).alias("_usd")), "symbol", "left")
    cross = tagged.groupBy("ts").agg(
        (F.count(F.when(F.col("z") < -0.5, 1)) / F.nullif(F.count("z"), F.lit(0))).alias("d_mkt_stress_frac"),
        F.avg(F.when(F.col("_usd"), S.clip("z", -5.0, 5.0))).alias("d_mkt_mean_z_usd"),
        F.count(F.when(F.col("z") <= -1, 1)).alias("d_mkt_beyond_1d"))
    days = asof(cross, base.select("ts", "price"), ["price"], [], 2 * HOUR)
    w = Window.orderBy("ts")
    lp = F.log("price")
    vol = w.rowsBetween(-29, 0)
    return days.withColumn("_step", lp - F.lag(lp, 1).over(w)).select(
        "ts", "d_mkt_stress_frac", "d_mkt_mean_z_usd", "d_mkt_beyond_1d",
        F.sum("d_mkt_beyond_1d").over(w.rowsBetween(-6, 0)).alias("d_mkt_beyond_7d"),
        *[(lp - F.lag(lp, k).over(w)).alias(f"d_eth_ret_{k}d") for k in (1, 7)],
        F.when(F.count("_step").over(vol) >= 10, F.stddev_samp("_step").over(vol)).alias("d_eth_vol_30d"))
