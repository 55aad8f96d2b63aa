"""Escalation and contagion tables: what is known about an episode at its decision hour, and about pairs of assets.

Range conditions are turned into hour keys throughout, so the joins are equalities on (symbol, hour) or on the hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.operators.episodes import episode_hours
from pegwatch.operators.series import asof
from pegwatch.rules import DAY, HOUR, SEVERE, Rules

FOLLOW = 168 * HOUR
LONG_HOURS = 24
# Beta priors for an asset's severe and long shares, and for follow shares.
HISTORY_PRIOR = (1.0, 4.0)
FOLLOW_PRIOR = (0.5, 9.5)


def episode_history(eps: DataFrame, severe_level: float) -> DataFrame:
    """What each asset's earlier episodes say when a new one starts."""
    before = Window.partitionBy("symbol").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    severe = F.col("severity").isin(*SEVERE).cast("int")
    long = ((F.col("t1") - F.col("t0")) / HOUR + 1 >= LONG_HOURS).cast("int")
    depth = F.greatest(F.lit(0.0), -F.col("held_min_dev")) / severe_level
    a, b = HISTORY_PRIOR
    n = F.count("*").over(before)
    n_sev, n_long = F.coalesce(F.sum(severe).over(before), F.lit(0)), F.coalesce(F.sum(long).over(before), F.lit(0))
    return eps.select(
        "*", n.alias("prior_episodes"), n_sev.alias("prior_severe"), n_long.alias("prior_long"),
        ((n_sev + a) / (n + a + b)).alias("prior_severe_share"), ((n_long + a) / (n + a + b)).alias("prior_long_share"),
        F.coalesce(F.max(F.when(F.col("held_min_dev").isNotNull(), depth)).over(before), F.lit(0.0)).alias("prior_max_depth_frac"),
        F.lag("t1").over(Window.partitionBy("symbol").orderBy("t0")).alias("_prev_end"))


def escalation(eps: DataFrame, dev: DataFrame, landmarks: Sequence[int], rules: Rules, under: DataFrame | None = None) -> DataFrame:
    """One row per (episode, landmark): state at the decision hour, run-up, history and both outcomes. Deviations
    beyond +-1 count as +-1. ``under`` (symbol, ts, und_z_now) tells whether a wrapper's underlying is below its band."""
    level = rules.severe_level
    dev = dev.withColumns({c: S.clip(c, -1.0, 1.0) for c in ("dev", "dev_obs")})
    first_seen = dev.filter("dev is not null").groupBy("symbol").agg(F.min("ts").alias("_seen"))
    rows = episode_history(eps, level).join(first_seen, "symbol").withColumn(
        "landmark", F.explode(F.array(*[F.lit(x) for x in landmarks])))
    rows = rows.withColumn("ts", F.greatest(F.col("t0") + F.col("landmark") * HOUR, F.col("tk")))
    key = ["symbol", "t0", "landmark"]
    hours = rows.select(*key, F.col("ts").alias("tau"), "theta", S.hour_keys(F.col("t0") - 168 * HOUR, "ts").alias("ts"))
    seen = hours.join(dev.select("symbol", "ts", "dev", "dev_obs"), ["symbol", "ts"])
    t, t0 = F.col("ts"), F.col("t0")
    own = F.when(t >= t0, F.col("dev_obs"))
    prev = F.last(own, True).over(Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    x, inside = F.col("dev"), t >= t0
    state = seen.withColumn("_own", own).withColumn("_prev", prev).groupBy(*key).agg(
        F.min(F.when(F.col("_own").isNotNull() & F.col("_prev").isNotNull(), F.greatest("_own", "_prev"))).alias("_held"),
        (F.greatest(F.lit(0.0), -F.min(F.when(inside, x))) / level).alias("_depth"), F.count(F.when(inside, x)).alias("_known"),
        F.max(F.when(t == t0, x / F.col("theta"))).alias("ep_z_first"),
        F.count(F.when(inside & (x <= -F.col("theta")), 1)).alias("ep_hours_below"),
        F.max(F.when(t == F.col("tau"), (x > -F.col("theta") * rules.band_frac).cast("int"))).alias("ep_back_in_band"),
        F.min(F.when((t < t0) & (t >= t0 - 24 * HOUR), x / F.col("theta"))).alias("pre_z_min_24h"),
        F.avg(F.when(t < t0, x / F.col("theta"))).alias("pre_z_mean_168h"))
    severe = F.col("severity").isin(*SEVERE)
    dur = (F.col("t1") - F.col("t0")) / HOUR + 1
    if under is None:
        rows = rows.withColumn("und_z_now", F.lit(None).cast("double"))
    else:
        rows = rows.join(under.select("symbol", "ts", "und_z_now"), ["symbol", "ts"], "left")
    out = rows.join(state, key, "left").withColumn("decided_severe", F.coalesce(F.col("_held") <= -level, F.lit(False)))
    y_severe = F.when(~(F.col("decided_severe") | (F.col("ongoing") & ~severe)), severe.cast("int"))
    y_long = F.when(~((F.col("landmark") >= LONG_HOURS - 1) | (F.col("ongoing") & (dur < LONG_HOURS))), (dur >= LONG_HOURS).cast("int"))
    age = (F.col("ts") - F.col("_seen")) / float(DAY)
    return out.select(
        F.concat_ws("@", "symbol", F.col("t0").cast("string")).alias("episode_id"), *key, "ts", "severity", "held_min_dev",
        dur.alias("duration_h"), "ongoing", "decided_severe", y_severe.alias("y_severe"), y_long.alias("y_long"),
        F.when(F.col("_known") > 0, F.col("_depth")).alias("depth_frac"), "ep_z_first",
        F.coalesce("ep_hours_below", F.lit(0)).alias("ep_hours_below"), "ep_back_in_band", "pre_z_min_24h", "pre_z_mean_168h",
        "prior_episodes", "prior_severe", "prior_long", "prior_severe_share", "prior_long_share", "prior_max_depth_frac",
        ((F.col("ts") - F.col("_prev_end")) / HOUR).alias("hours_since_prior_end"), age.alias("asset_age_days"),
        F.log1p("prior_episodes").alias("log_prior_episodes"), F.log1p(F.greatest(age, F.lit(0.0))).alias("log_asset_age_days"),
        F.coalesce(F.col("und_z_now") <= -1, F.lit(False)).cast("double").alias("und_below"))


def severe_hours(eps: DataFrame, dev: DataFrame, level: float) -> DataFrame:
    """First hour of each episode at which two consecutive known samples are both at or beyond the level."""
    rows = episode_hours(eps).join(dev.filter("dev_obs is not null").select("symbol", "ts", "dev_obs"), ["symbol", "ts"])
    prev = F.lag("dev_obs").over(Window.partitionBy("symbol", "t0").orderBy("ts"))
    hit = F.col("_p").isNotNull() & (F.greatest("dev_obs", "_p") <= -level)
    return rows.withColumn("_p", prev).groupBy("symbol", "t0").agg(F.min(F.when(hit, F.col("ts"))).alias("severe_ts"))


def waits(eps: DataFrame, dev: DataFrame, level: float) -> DataFrame:
    """Hours from the decision hour to the first severe hour at or after the start; NULL if it never comes."""
    known = dev.filter("dev_obs is not null").withColumn("_p", F.lag("dev_obs").over(Window.partitionBy("symbol").orderBy("ts"))) \
        .withColumn("_pt", F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")))
    hits = known.filter(F.greatest("dev_obs", "_p") <= -level).filter("_p is not null").select(
        "symbol", F.col("_pt").alias("at"), F.lit(1).alias("_side"), F.col("ts").alias("_hit"))
    asks = eps.select("symbol", F.col("t0").alias("at"), F.lit(0).alias("_side"), "t0", "tk", "severity")
    ahead = Window.partitionBy("symbol").orderBy("at", "_side").rowsBetween(0, Window.unboundedFollowing)
    both = hits.unionByName(asks, allowMissingColumns=True).withColumn("severe_ts", F.first("_hit", True).over(ahead))
    return both.filter("_side = 0").select(
        "symbol", "t0", "severity", "severe_ts", F.greatest((F.col("severe_ts") - F.col("tk")) / HOUR, F.lit(0.0) * F.col("severe_ts")).alias("wait_h"))


def wait_summary(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count("*").alias("episodes"), F.count("wait_h").alias("reached"), F.percentile("wait_h", 0.5).alias("median_h"),
        F.avg((F.coalesce("wait_h", F.lit(1e9)) <= 6).cast("double")).alias("within_6h"),
        F.avg((F.coalesce("wait_h", F.lit(1e9)) <= 24).cast("double")).alias("within_24h"))


def clusters(times: DataFrame, tau: str, gap: int = 72 * HOUR) -> DataFrame:
    """Cluster number per decision hour: a silence of more than ``gap`` starts a new one. Works on the distinct
    hours, of which there are no more than the calendar has."""
    w = Window.orderBy(tau)
    new = F.coalesce((F.col(tau) - F.lag(tau).over(w) > gap).cast("int"), F.lit(1))
    marked = times.select(tau).distinct().withColumn("_new", new)
    return marked.select(tau, (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("cluster"))


def seeds(eps: DataFrame, dev: DataFrame, kind: str, rules: Rules, start: int = 0) -> DataFrame:
    """Episodes that could spread, the hour each is decided and its time cluster, split by the cluster's first seed."""
    rows = eps.filter(F.col("t0") >= start)
    if kind == "severe":
        rows = rows.filter(F.col("severity").isin(*SEVERE))
        rows = rows.join(severe_hours(rows, dev, rules.severe_level), ["symbol", "t0"], "left")
        tau = F.greatest("severe_ts", "tk")
    else:
        tau = F.col("tk")
    rows = rows.withColumn("tau", tau)
    rows = rows.join(clusters(rows, "tau"), "tau")
    first = rows.groupBy("cluster").agg(F.min("tau").alias("_first"))
    split = F.when(F.col("_first") <= rules.valid_end, "train").otherwise("test")
    return rows.join(first, "cluster").select(
        F.concat_ws("@", "symbol", F.col("t0").cast("string")).alias("seed_id"), F.col("symbol").alias("seed"),
        F.col("t0").alias("seed_t0"), F.col("severity").alias("seed_severity"), F.col("category").alias("seed_category"),
        F.col("peg").alias("seed_peg"), "tau", "cluster", split.alias("split"))


def candidates(seed_rows: DataFrame, eps: DataFrame, dev: DataFrame, windows: Sequence[int] = (72, 168),
               known: bool = False) -> DataFrame:
    """Every asset a seed could spread to, with its follow labels.

    An asset qualifies with a sample in the day up to tau, outside (and not within a day after) its own episodes and
    not collapsed. Seeds meet assets through the hours of that day, an equality join; no asset list is multiplied.
    """
    t_ep = "tk" if known else "t0"
    taus = seed_rows.select("tau").distinct().select("tau", S.hour_keys(F.col("tau") - 24 * HOUR, "tau").alias("ts"))
    alive = taus.join(dev.filter("dev is not null").select("ts", F.col("symbol").alias("cand")), "ts").select("tau", "cand").distinct()
    death = eps.filter("terminal").groupBy(F.col("symbol").alias("cand")).agg(F.min(t_ep).alias("_death"))
    busy = eps.select(F.col("symbol").alias("cand"), S.hour_keys(F.col(t_ep), F.col("t1") + 23 * HOUR).alias("tau")).distinct()
    free = alive.join(death, "cand", "left").filter("_death is null or _death > tau").drop("_death").join(
        busy, ["cand", "tau"], "left_anti")
    longest = max(windows) * HOUR
    ahead = eps.select(F.col("symbol").alias("cand"), "t0", S.hour_keys(F.col("t0") - longest, F.col("t0") - HOUR).alias("tau"))
    follow = ahead.groupBy("cand", "tau").agg(F.min("t0").alias("_next"))
    end = dev.agg(F.max("ts")).scalar()
    out = free.join(follow, ["cand", "tau"], "left").withColumn("_end", end)
    ys = [
        F.when(F.col("tau") + w * HOUR <= F.col("_end"), F.coalesce((F.col("_next") <= F.col("tau") + w * HOUR).cast("int"), F.lit(0))).alias(f"y{w}")
        for w in windows
    ]
    return seed_rows.join(out.select("cand", "tau", *ys), "tau").filter("cand <> seed")


def running_count(events: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Events up to each event time per key; without keys it first shrinks to one row per hour."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    per = events.groupBy(*keys, F.col(ts).alias("ts")).agg(F.count("*").alias("_c"))
    return per.select(*keys, "ts", F.sum("_c").over(w).alias("cum"))


def follow(pairs: DataFrame, eps: DataFrame) -> DataFrame:
    """Share of other assets' earlier episodes that the candidate followed within a week, and the same over the
    seed's own episodes; only episodes whose week had closed by tau count."""
    ahead = eps.select(F.col("symbol").alias("cand"), S.hour_keys(F.col("t0") - FOLLOW, F.col("t0") - HOUR).alias("t0")).distinct()
    events = eps.select(F.col("symbol").alias("seed"), "t0")
    followed = events.join(ahead, "t0").filter("seed <> cand")
    rows = pairs.withColumn("ts", F.col("tau") - FOLLOW - HOUR)

    def attach(df: DataFrame, source: DataFrame, keys: list[str], name: str) -> DataFrame:
        asks = df.select(*keys, "ts").distinct()
        hit = asof(asks, running_count(source, keys, "t0"), ["cum"], keys).select(*keys, "ts", F.coalesce("cum", F.lit(0)).alias(name))
        return df.join(hit, [*keys, "ts"])

    rows = attach(rows, followed, ["cand"], "_k")
    rows = attach(rows, events, [], "_n")
    rows = attach(rows, events.withColumnRenamed("seed", "cand"), ["cand"], "_own")
    rows = attach(rows, followed, ["seed", "cand"], "_ks")
    rows = attach(rows, events, ["seed"], "_ns")
    a, b = FOLLOW_PRIOR
    return rows.select(
        *pairs.columns, ((F.col("_k") + a) / (F.col("_n") - F.col("_own") + a + b)).alias("follow_rate"),
        ((F.col("_ks") + a) / (F.col("_ns") + a + b)).alias("codepeg_share"))

