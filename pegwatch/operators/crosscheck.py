"""Episodes against a second price source: evidence per episode, shifted placebo windows, episodes only it saw.

``second`` has one row per (symbol, ts) with ``mid`` and ``high`` deviations (NULL where there is no evidence) and
``n`` trades. Windows become hour keys, so every check is an equality join on (symbol, ts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.functions.scalars import hour_keys
from pegwatch.operators.episodes import detect, episode_hours
from pegwatch.rules import DAY, HOUR, STATUSES, Rules

BEFORE, CHECK, AFTER = 2 * HOUR, 72 * HOUR, 2 * HOUR


def with_window(eps: DataFrame) -> DataFrame:
    return eps.withColumn("w0", F.col("t0") - BEFORE).withColumn(
        "w1", F.least(F.col("t1"), F.col("t0") + CHECK) + AFTER)


def check(eps: DataFrame, second: DataFrame, rules: Rules, evidence: tuple[int, int] = (10, 3),
          keys: Sequence[str] = ("symbol", "t0")) -> DataFrame:
    """Status of each window and the numbers behind it. ``evidence`` is the number of trades and traded hours a
    contradiction needs."""
    keys = list(keys)
    rows = eps if "w0" in eps.columns else with_window(eps)
    hours = rows.select(*keys, hour_keys("w0", "w1").alias("ts"))
    facts = hours.join(second, ["symbol", "ts"]).groupBy(*keys).agg(
        F.count("mid").alias("hours"), F.count("high").alias("robust_hours"), F.sum("n").alias("trades"),
        F.min("mid").alias("min_mid"), F.max("mid").alias("max_mid"), F.max(F.abs("mid")).alias("_abs"),
        F.min("high").alias("min_high"))
    out = rows.join(facts, keys, "left")
    band = F.col("theta") * rules.band_frac
    status = (
        F.when(F.col("min_high") <= -F.col("theta"), "confirmed")
        .when(F.col("min_high") <= -band, "partial")
        .when((F.col("trades") >= evidence[0]) & (F.col("hours") >= evidence[1]) & (F.col("_abs") < band), "contradicted")
        .otherwise("unverified")
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("hours", "robust_hours", "trades")]
    return out.withColumn("status", status).select(*eps.columns, *counts, "min_mid", "max_mid", "min_high", "status")


def placebo(eps: DataFrame, all_eps: DataFrame, second: DataFrame, rules: Rules, shifts: Sequence[int],
            evidence: tuple[int, int] = (10, 3)) -> DataFrame:
    """The same check at shifted windows inside the data with no labelled episode within a day."""
    span = second.filter("mid is not null").groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    moved = eps.select("symbol", "category", "theta", F.col("t0").alias("episode_start"), "t1",
                       F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift_days"))
    moved = with_window(moved.withColumn("t0", F.col("episode_start") + F.col("shift_days") * DAY)
                        .withColumn("t1", F.col("t1") + F.col("shift_days") * DAY))
    inside = moved.join(span, "symbol").filter("w0 >= _a and w1 <= _b").drop("_a", "_b")
    near = episode_hours(all_eps, DAY, DAY).select("symbol", "ts").distinct()
    keys = ["symbol", "episode_start", "shift_days"]
    touched = inside.select(*keys, hour_keys("w0", "w1").alias("ts")).join(near, ["symbol", "ts"], "left_semi").select(*keys).distinct()
    return check(inside.join(touched, keys, "left_anti"), second, rules, evidence, keys)


def second_only(second: DataFrame, eps: DataFrame, rules: Rules, hours: int = 2) -> DataFrame:
    """Episodes of the second source, robust in their first day, with no labelled episode within a day."""
    known = second.filter("high is not null")
    found = detect(known, ["symbol"], "high", "theta", rules.min_run, rules.severe, rules.band_frac, rules.recovery,
                   rules.dead_dev)
    near = episode_hours(eps, DAY, DAY).select("symbol", F.col("ts").alias("t0")).distinct()
    fresh = found.join(near, ["symbol", "t0"], "left_anti").select("symbol", "t0", "t1")
    reach = F.greatest(F.col("t1"), F.col("t0") + DAY)
    rows = fresh.select("symbol", "t0", "t1", hour_keys("t0", reach).alias("ts")).join(second, ["symbol", "ts"])
    inside = F.col("ts") <= F.col("t1")
    return rows.groupBy("symbol", "t0", "t1").agg(
        F.count(F.when((F.col("ts") <= F.col("t0") + DAY) & (F.col("high") <= -F.col("theta")), 1)).alias("_robust"),
        F.min(F.when(inside, F.col("high"))).alias("min_high"),
        F.count(F.when(inside, F.col("high"))).alias("robust_hours"),
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("trades"),
    ).filter(F.col("_robust") >= hours).drop("_robust")


def known_events(events: DataFrame, second: DataFrame, hours: int = 72) -> DataFrame:
    """What the second source shows around each documented event."""
    near = events.select("symbol", "event_ts", hour_keys(
        F.col("event_ts") - hours * HOUR, F.col("event_ts") + hours * HOUR).alias("ts")).join(second, ["symbol", "ts"])
    facts = near.groupBy("symbol", "event_ts").agg(
        F.count("mid").alias("hours"), F.min("mid").alias("min_mid"), F.min("high").alias("min_high"),
        F.max((F.col("high") <= -F.col("theta")).cast("int")).alias("_b"))
    return events.select("symbol", "event_ts").join(facts, ["symbol", "event_ts"], "left").select(
        "symbol", "event_ts", F.coalesce("hours", F.lit(0)).alias("hours"), "min_mid", "min_high",
        (F.coalesce("_b", F.lit(0)) == 1).alias("beyond_threshold"))


def status_table(checks: DataFrame, by: str) -> DataFrame:
    """Crosstab of status, number of episodes and the confirmed share of the checked ones."""
    t = checks.groupBy(by).pivot("status", list(STATUSES)).count().na.fill(0, list(STATUSES))
    checked = F.col("confirmed") + F.col("partial") + F.col("contradicted")
    return t.withColumn("episodes", sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))).withColumn(
        "confirmed_of_checked", F.round(F.when(checked > 0, F.col("confirmed") / checked), 2))


def status_shares(checks: DataFrame, sample: str) -> DataFrame:
    """Share of each status per sample, over all windows and over those with at least one robust hour."""
    scopes = F.explode(F.when(F.col("robust_hours") > 0, F.array(F.lit("all"), F.lit("robust"))).otherwise(F.array(F.lit("all"))))
    counts = checks.select(sample, "status", scopes.alias("scope")).groupBy(sample, "scope").agg(
        F.count("*").alias("_all"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
    return counts.select(sample, "scope", F.col("_all").alias("windows"), *[(F.col(s) / F.col("_all")).alias(s) for s in STATUSES])


def exclusions(checks: DataFrame, keep: Sequence[str] = ("confirmed", "partial")) -> DataFrame:
    """(symbol, start) of every checked episode whose status is not one to keep."""
    return checks.filter(~F.col("status").isin(*keep)).select("symbol", F.col("t0").alias("start"), "status")
