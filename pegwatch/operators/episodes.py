"""Depeg episodes: detection, depth, quality flags, labels and the numbers reported about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.operators.series import ordered
from pegwatch.rules import DAY, HOUR, Rules


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def detect(dev: DataFrame, keys: Sequence[str] = ("symbol",), value: str = "dev_obs", theta="theta", min_run=2,
           severe=0.05, band_frac=0.5, recovery=24, dead_dev: float = -0.50) -> DataFrame:
    """Confirm-and-recover episodes as gaps and islands over the known samples of each key.

    A run of ``min_run`` samples at or beyond the threshold (or one beyond ``severe``) confirms an episode; it lasts
    until ``recovery`` consecutive samples lie inside the band. One shuffle on the keys serves every step. The
    parameters may be columns, which is how the sensitivity grid runs.
    """
    keys = list(keys)
    theta = F.col(theta) if isinstance(theta, str) else _c(theta)
    min_run, severe, recovery = _c(min_run), _c(severe), _c(recovery)
    w = ordered(keys)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(value)
    rows = (
        dev.filter(x.isNotNull())
        .withColumn("_theta", theta)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_hit", x <= -F.col("_theta"))
        .withColumn("_bad", x <= -F.col("_theta") * band_frac)
        .withColumn("_prev", F.lag(value).over(w))
        .withColumn("_prev_ts", F.lag("ts").over(w))
        .withColumn("_last_miss", F.coalesce(F.last(F.when(~F.col("_hit"), F.col("_rn")), True).over(past), F.lit(0)))
        .withColumn("_prev_bad", F.last(F.when(F.col("_bad"), F.col("_rn")), True).over(before))
        .withColumn("_open", F.col("_hit") & ~F.coalesce(F.lag("_hit").over(w), F.lit(False)))
        .withColumn("_run_start", F.last(F.when(F.col("_open"), F.col("ts")), True).over(past))
        .withColumn("_new", F.col("_bad") & (F.col("_prev_bad").isNull() | (F.col("_rn") - F.col("_prev_bad") > recovery)))
        .withColumn("_seg", F.sum(F.col("_new").cast("int")).over(past))
    )
    trigger = F.col("_hit") & ((F.col("_rn") - F.col("_last_miss") >= min_run) | (x <= -severe))
    seg = Window.partitionBy(*keys, "_seg")
    rows = (
        rows.filter("_seg > 0")
        .withColumn("_conf", F.min(F.when(trigger, F.col("ts"))).over(seg))
        .withColumn("_start", F.min(F.when(trigger, F.col("_run_start"))).over(seg))
        .withColumn("_end", F.max(F.when(F.col("_bad"), F.col("ts"))).over(seg))
        .filter("_conf is not null")
    )
    inside = (F.col("ts") >= F.col("_start")) & (F.col("ts") <= F.col("_end"))
    pair = inside & (F.col("_prev_ts") >= F.col("_start"))
    return (
        rows.groupBy(*keys, "_seg")
        .agg(
            F.min("_start").alias("t0"),
            F.min("_end").alias("t1"),
            F.min("_conf").alias("confirmed_at"),
            F.count(F.when(inside & F.col("_hit"), 1)).alias("hours_below"),
            F.min(F.when(F.col("ts") >= F.col("_conf"), x)).alias("min_dev"),
            F.min(F.when(pair, F.greatest(x, F.col("_prev")))).alias("held_min_dev"),
            F.count(F.when(inside & (x <= dead_dev), 1)).alias("hours_beyond_dead"),
            ((F.max("_rn") - F.max(F.when(F.col("_bad"), F.col("_rn")))) < F.max(recovery)).alias("ongoing"),
        )
        .drop("_seg")
    )


def detect_with(dev: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",), value: str = "dev_obs") -> DataFrame:
    return detect(dev, keys, value, "theta", rules.min_run, rules.severe, rules.band_frac, rules.recovery, rules.dead_dev)


def raw_episodes(dev: DataFrame, rules: Rules) -> DataFrame:
    """Detected episodes with category, peg, source and severity."""
    meta = dev.groupBy("symbol").agg(*[F.min(c).alias(c) for c in ("category", "peg", "source", "theta")])
    eps = detect_with(dev, rules).join(meta, "symbol")
    return eps.withColumn("severity", S.severity("held_min_dev", rules.tiers)).withColumn(
        "tk", S.known_time("t0", "confirmed_at"))


def episode_hours(eps: DataFrame, before: int = 0, after: int = 0, cols: Sequence[str] = ()) -> DataFrame:
    """One row per hour of every episode, padded by ``before`` and ``after`` seconds: the equality key that
    replaces a range join with the hourly table."""
    return eps.select("symbol", "t0", *cols, S.hour_keys(F.col("t0") - before, F.col("t1") + after).alias("ts"))


def held_depth(dev: DataFrame, eps: DataFrame, value: str = "dev_obs") -> DataFrame:
    """Deepest level held for two consecutive known samples of each episode, NULL with fewer than two."""
    inside = episode_hours(eps).join(dev.filter(F.col(value).isNotNull()).select("symbol", "ts", value), ["symbol", "ts"])
    w = Window.partitionBy("symbol", "t0").orderBy("ts")
    pairs = inside.withColumn("_p", F.lag(value).over(w))
    return pairs.groupBy("symbol", "t0").agg(
        F.min(F.when(F.col("_p").isNotNull(), F.greatest(F.col(value), F.col("_p")))).alias("held_min_dev"),
        F.count("*").alias("samples"),
    )


def second_source(eps: DataFrame, dev_all: DataFrame, order: Sequence[str], rules: Rules) -> DataFrame:
    """Whether other sources saw the episode within an hour of it: yes, no or blank. Sources are read in order;
    a later one with data overwrites, except that it only turns the answer to no when it has samples."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    others = dev_all.filter("dev is not null").select("symbol", "ts", "dev", "theta", rank.alias("_rank"), "source")
    hours = eps.select("symbol", "t0", F.col("source").alias("_used"),
                       S.hour_keys(F.col("t0") - HOUR, F.col("t1") + HOUR).alias("ts"))
    seen = (
        hours.join(others, ["symbol", "ts"]).filter("source <> _used")
        .groupBy("symbol", "t0", "_rank")
        .agg(F.max((F.col("dev") <= -F.col("theta") * rules.band_frac).cast("int")).alias("_hit"))
        .groupBy("symbol", "t0").agg(F.max_by("_hit", "_rank").alias("_hit"))
    )
    answer = F.when(F.col("_hit") == 1, "yes").when(F.col("_hit") == 0, "no").otherwise("")
    return eps.join(seen, ["symbol", "t0"], "left").withColumn("confirmed_by_second_source", answer).drop("_hit")


def quality(eps: DataFrame, rules: Rules, exclusions: DataFrame | None = None) -> DataFrame:
    """Flags doubtful episodes, finds the collapse of an asset and drops what comes after it."""
    singles = eps.filter("hours_below = 1").groupBy("t0").agg(F.count("*").alias("_singles"))
    out = eps.join(singles, "t0", "left")
    if exclusions is not None:
        out = out.join(exclusions.select("symbol", F.col("start").alias("t0"), F.lit(True).alias("_listed")),
                       ["symbol", "t0"], "left")
    else:
        out = out.withColumn("_listed", F.lit(None).cast("boolean"))
    duration = (F.col("t1") - F.col("t0")) / HOUR + 1
    suspect = (
        F.when((F.round("min_dev", 5) <= rules.snapback_dev) & ~F.col("ongoing") & (duration <= rules.snapback_hours),
               "snapback")
        .when((F.col("hours_below") == 1) & (F.col("_singles") >= rules.cluster_assets), "same_hour_cluster")
        .when(F.coalesce("_listed", F.lit(False)), "excluded")
        .otherwise("")
    )
    out = out.withColumn("suspect", suspect)
    death = F.min(F.when((F.col("suspect") == "") & (F.col("hours_beyond_dead") >= rules.dead_hours), F.col("t0"))).over(
        Window.partitionBy("symbol"))
    return (
        out.withColumn("death", death)
        .withColumn("dropped", F.coalesce(F.col("t0") > F.col("death"), F.lit(False)))
        .withColumn("terminal", F.coalesce(F.col("t0") == F.col("death"), F.lit(False)))
        .drop("_singles", "_listed")
    )


def clean(eps: DataFrame) -> DataFrame:
    """Episodes that passed the quality rules and were not dropped."""
    out = eps.filter(S.is_clean("suspect"))
    return out.filter(~F.col("dropped")) if "dropped" in eps.columns else out


def labels(dev: DataFrame, eps: DataFrame, rules: Rules, value: str = "dev") -> DataFrame:
    """Per asset-hour: inside an episode, and per horizon whether a clean episode starts within it.

    NULL inside an episode, without a deviation, where the end of the data hides the answer, in the run-up and body
    of flagged episodes and after a collapse. Episodes reach the hours through (symbol, hour) keys only.
    """
    kept = eps.filter(~F.col("dropped"))
    good = S.is_clean("suspect")
    longest = max(rules.horizons) * HOUR
    hours = kept.select("symbol", "t0", good.alias("_good"), S.hour_keys(F.col("t0") - longest, F.col("t1")).alias("ts"))
    marks = [F.max((F.col("_good") & (F.col("ts") >= F.col("t0"))).cast("int")).alias("_in")]
    for h in rules.horizons:
        reach = F.col("ts") >= F.col("t0") - h * HOUR
        marks.append(F.max((F.col("_good") & reach & (F.col("ts") < F.col("t0"))).cast("int")).alias(f"_a{h}"))
        marks.append(F.max((~F.col("_good") & reach).cast("int")).alias(f"_m{h}"))
    flags = hours.groupBy("symbol", "ts").agg(*marks)
    death = eps.groupBy("symbol").agg(F.min("death").alias("_death"))
    last = F.max(F.when(F.col(value).isNotNull(), F.col("ts"))).over(Window.partitionBy("symbol"))
    out = dev.withColumn("_last", last).join(death, "symbol", "left").join(flags, ["symbol", "ts"], "left")
    inside = F.coalesce("_in", F.lit(0))
    cols = []
    for h in rules.horizons:
        y = F.coalesce(F.col(f"_a{h}"), F.lit(0))
        hidden = (
            (inside == 1) | F.col(value).isNull()
            | ((y == 0) & (F.col("ts") > F.col("_last") - h * HOUR))
            | (F.coalesce(F.col(f"_m{h}"), F.lit(0)) == 1)
            | F.coalesce(F.col("ts") >= F.col("_death"), F.lit(False))
        )
        cols.append(F.when(~hidden, y).alias(f"y{h}"))
    return out.select(*[F.col(c) for c in dev.columns], inside.alias("in_episode"), *cols)


def onset_flags(dev: DataFrame, eps: DataFrame, horizon: int, value: str = "dev") -> DataFrame:
    """The window form of one unmasked horizon label: looks ahead in a range frame over the dense series."""
    starts = eps.select("symbol", F.col("t0").alias("ts"), F.lit(1).alias("_s"))
    ends = eps.groupBy("symbol", F.col("t0").alias("ts")).agg(F.max("t1").alias("_e"))
    w = ordered(["symbol"])
    rows = dev.join(starts, ["symbol", "ts"], "left").join(ends, ["symbol", "ts"], "left")
    ahead = F.max("_s").over(w.rangeBetween(HOUR, horizon * HOUR))
    open_end = F.last("_e", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col(value).isNotNull(), F.col("ts"))).over(Window.partitionBy("symbol"))
    rows = rows.withColumn("_y", F.coalesce(ahead, F.lit(0))).withColumn("_o", open_end).withColumn("_l", last)
    inside = F.coalesce(F.col("ts") <= F.col("_o"), F.lit(False))
    hidden = inside | F.col(value).isNull() | ((F.col("_y") == 0) & (F.col("ts") > F.col("_l") - horizon * HOUR))
    return rows.select("symbol", "ts", value, inside.cast("int").alias("in_episode"),
                       F.when(~hidden, F.col("_y")).alias("y"))


def coverage(dev: DataFrame, rules: Rules, value: str = "dev_obs") -> DataFrame:
    """First and last hour, coverage, share of flat steps and the median value over reference per asset."""
    known = dev.filter(F.col(value).isNotNull())
    step = F.abs(F.col(value) - F.lag(value).over(ordered(["symbol"])))
    stats = known.withColumn("_step", step).groupBy("symbol").agg(
        F.min("ts").alias("first_hour"), F.max("ts").alias("last_hour"), F.count("*").alias("n_hours"),
        F.coalesce(F.avg(F.when(F.col("_step").isNotNull(), (F.col("_step") < 1e-7).cast("double"))), F.lit(1.0)).alias("flat_share"),
        F.percentile(F.col(value) + 1.0, 0.5).alias("median_value_to_ref"),
    )
    width = dev.groupBy("symbol").agg(F.count("*").alias("_all"), F.count("dev").alias("_filled"))
    return stats.join(width, "symbol").select(
        "symbol", "first_hour", "last_hour", "n_hours",
        F.round(F.col("n_hours") / F.col("_all"), 3).alias("coverage"),
        F.round(F.col("_filled") / F.col("_all"), 3).alias("coverage_filled"),
        F.round("flat_share", 3).alias("flat_share"),
        (F.col("flat_share") >= rules.flat_share).alias("derived_suspect"),
        F.round("median_value_to_ref", 4).alias("median_value_to_ref"),
    )


def grid(dev: DataFrame, rules: Rules, usd: Sequence[float], eth: Sequence[float], runs: Sequence[int]) -> DataFrame:
    """Episode counts for every (dollar threshold, ether threshold, run length) at the rules' recovery.

    An asset only ever meets the thresholds of its own peg, so a row is copied once per (own threshold, run) and the
    counts of the two pegs are added per combination afterwards.
    """
    def params(thetas: Sequence[float]) -> Column:
        return F.array(*[F.struct(F.lit(float(t)).alias("g_theta"), F.lit(n).alias("g_run")) for t in thetas for n in runs])

    in_usd = F.col("peg") == "USD"
    steady = coverage(dev, rules).filter("not derived_suspect").select("symbol")
    rows = dev.join(steady, "symbol", "left_semi").filter("dev_obs is not null").select(
        "symbol", "ts", "dev_obs", in_usd.alias("g_usd"), F.explode(F.when(in_usd, params(usd)).otherwise(params(eth))).alias("g"))
    keys = ["g_usd", "g_theta", "g_run"]
    eps = detect(rows.select("symbol", "ts", "dev_obs", "g_usd", "g.*"), ["symbol", *keys], "dev_obs", "g_theta", F.col("g_run"),
                 rules.severe, rules.band_frac, rules.recovery, rules.dead_dev)
    counts = eps.groupBy(*keys).agg(F.count("*").alias("n"))
    each = dev.sparkSession.createDataFrame(
        [(float(u), float(e), n) for u in usd for e in eth for n in runs], "theta_usd double, theta_eth double, min_run int")
    own = F.when(F.col("g_usd"), F.col("theta_usd")).otherwise(F.col("theta_eth"))
    met = each.join(counts, (F.col("g_run") == F.col("min_run")) & (F.col("g_theta") == own), "left")
    return met.groupBy("theta_usd", "theta_eth", "min_run").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("episodes"))


def known_events(events: DataFrame, eps: DataFrame, dev: DataFrame, days: int = 3) -> DataFrame:
    """What is known around each documented event: whether there is data within ``days`` of it, how many episodes
    that passed the quality rules overlap those days, the deepest of them and the first start."""
    lo, hi = F.col("event_ts") - days * DAY, F.col("event_ts") + days * DAY
    key = ["symbol", "event_ts"]
    over = events.select(*key).join(eps.select("symbol", "t0", "t1", "min_dev"), "symbol").filter((F.col("t0") <= hi) & (F.col("t1") >= lo))
    found = over.groupBy(*key).agg(F.count("*").alias("episodes"), F.min("min_dev").alias("deepest"), F.min("t0").alias("first_start"))
    data = events.select(*key, S.hour_keys(lo, hi).alias("ts")).join(dev.filter("dev is not null").select("symbol", "ts"), ["symbol", "ts"])
    return events.select(*key).join(found, key, "left").join(data.groupBy(*key).agg(F.count("*").alias("_n")), key, "left").select(
        *key, F.col("_n").isNotNull().alias("data"), F.coalesce("episodes", F.lit(0)).alias("episodes"), "deepest", "first_start")


def year_by_category(eps: DataFrame) -> DataFrame:
    """Counts by year, by the days inside it and by category, with every margin."""
    at = F.timestamp_seconds("t0")
    dated = eps.select(F.date_format(at, "yyyy").alias("year"), F.date_format(at, "yyyy-MM-dd").alias("day"), "category")
    y, d, c = F.col("year"), F.col("day"), F.col("category")
    return dated.groupingSets([[y, d, c], [y, d], [y, c], [y], [c], []], y, d, c).agg(F.count("*").alias("episodes")).select(
        *[F.coalesce(k, F.lit("total")).alias(k) for k in ("year", "day", "category")], "episodes")


def concentration(eps: DataFrame, k: int = 5) -> DataFrame:
    """Share of all episodes held by the k assets with the most."""
    counts = eps.groupBy("symbol").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.orderBy(F.desc("n"), "symbol").limit(k).agg(
        F.sum("n").alias("top_episodes"), (F.sum("n") / F.max(total)).alias("top_share"))


def report_numbers(eps: DataFrame, rules: Rules, minimum: int) -> DataFrame:
    """Counts behind the checkpoint report and whether there are enough clean episodes to go on."""
    good = S.is_clean("suspect") & ~F.col("dropped")
    split = F.when(F.col("t0") <= rules.train_end, "train").when(F.col("t0") <= rules.valid_end, "valid").otherwise("test")
    return eps.agg(
        F.count("*").alias("episodes"), F.count(F.when(~S.is_clean("suspect"), 1)).alias("flagged"),
        F.count(F.when(F.col("dropped"), 1)).alias("dropped"),
        *[F.count(F.when(good & (split == s), 1)).alias(s) for s in ("train", "valid", "test")],
        (F.count(F.when(good, 1)) >= minimum).alias("enough"))
