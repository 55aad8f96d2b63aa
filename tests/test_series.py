import random

import pytest
from pyspark.sql import functions as F

from pegwatch.functions import scalars as S
from pegwatch.operators import episodes as E
from pegwatch.operators import features as X
from pegwatch.operators import series as T
from pegwatch.rules import HOUR, Rules


def frame(spark, values, symbol="a"):
    rows = [(symbol, i * HOUR, v, 0.01) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts bigint, dev_obs double, theta double")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def scan(values, theta, min_run, severe, band, recovery):
    """Plain scan of one series, the yardstick for the set-based form."""
    out, run, start, cur, good = [], 0, None, None, 0
    for t, d in enumerate(values):
        if d is None:
            continue
        if cur is None:
            if d > -theta:
                run = 0
                continue
            start = t if run == 0 else start
            run += 1
            if run >= min_run or d <= -severe:
                cur, good = [start, t, t, run, d], 0
            continue
        cur[3] += d <= -theta
        cur[4] = min(cur[4], d)
        if d <= -theta * band:
            cur[2], good = t, 0
        else:
            good += 1
            if good >= recovery:
                out.append((*cur, False))
                cur, run = None, 0
    if cur is not None:
        out.append((*cur, True))
    return [(s * HOUR, c * HOUR, e * HOUR, n, round(m, 9), o) for s, c, e, n, m, o in out]


def found(df):
    return rows(df.withColumn("m", F.round("min_dev", 9)), "t0", "confirmed_at", "t1", "hours_below", "m", "ongoing")


def test_dip_confirms_and_recovers(spark):
    v = [0.0] * 5 + [-0.02] * 3 + [0.0] * 30
    assert found(E.detect(frame(spark, v))) == [(5 * HOUR, 6 * HOUR, 7 * HOUR, 3, -0.02, False)]


def test_single_moderate_sample_is_no_episode_but_a_severe_one_is(spark):
    assert found(E.detect(frame(spark, [0.0, -0.02] + [0.0] * 30))) == []
    assert found(E.detect(frame(spark, [0.0, -0.06] + [0.0] * 30)))[0][:3] == (HOUR, HOUR, HOUR)


def test_gap_neither_extends_nor_breaks_a_run(spark):
    v = [0.0, -0.02, None, None, -0.02] + [0.0] * 30
    assert found(E.detect(frame(spark, v)))[0][:3] == (HOUR, 4 * HOUR, 4 * HOUR)


@pytest.mark.parametrize("min_run,recovery", [(1, 3), (2, 6), (4, 5)])
def test_detection_equals_the_scan_on_random_series(spark, min_run, recovery):
    rng = random.Random(min_run * 10 + recovery)
    parts, want = None, {}
    for i in range(40):
        v = [None if rng.random() < 0.1 else rng.choice([0.0, -0.004, -0.006, -0.011, -0.02, -0.06]) for _ in range(120)]
        df = frame(spark, v, f"s{i}")
        parts = df if parts is None else parts.unionByName(df)
        want[f"s{i}"] = sorted(scan(v, 0.01, min_run, 0.05, 0.5, recovery))
    got = E.detect(parts, min_run=min_run, recovery=recovery).withColumn("m", F.round("min_dev", 9)).collect()
    for s, w in want.items():
        assert sorted((r.t0, r.confirmed_at, r.t1, r.hours_below, r.m, r.ongoing) for r in got if r.symbol == s) == w


def test_held_depth_needs_two_samples(spark):
    d = frame(spark, [0.0, -0.06, 0.0, -0.02, -0.03, 0.0])
    eps = spark.createDataFrame([("a", HOUR, HOUR), ("a", 3 * HOUR, 4 * HOUR)], "symbol string, t0 bigint, t1 bigint")
    assert rows(E.held_depth(d, eps), "t0", "held_min_dev", "samples") == [(HOUR, None, 1), (3 * HOUR, -0.02, 2)]


def test_densify_and_bounded_fill(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 5 * HOUR, 2.0)], "k string, ts bigint, v double")
    out = T.ffill(T.densify(df, ["k"]), "v", 2, ["k"])
    assert [r.v for r in out.orderBy("ts").collect()] == [1.0, 1.0, 1.0, None, None, 2.0]
    wide = T.densify(df, ["k"], first=F.lit(-HOUR).cast("bigint"), last=F.lit(6 * HOUR).cast("bigint"))
    assert [r.ts for r in wide.orderBy("ts").collect()] == [h * HOUR for h in range(-1, 7)]


def test_asof_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([("a", 100), ("a", 111), ("b", 100)], "k string, ts bigint")
    right = spark.createDataFrame([("a", 90, 1.0), ("a", 101, 2.0)], "k string, ts bigint, v double")
    got = T.asof(left, right, ["v"], ["k"], 10).orderBy("k", "ts").collect()
    assert [(r.k, r.ts, r.v) for r in got] == [("a", 100, 1.0), ("a", 111, 2.0), ("b", 100, None)]


def test_asof_grid_holds_until_next_or_stale(spark):
    obs = spark.createDataFrame([("a", 5, 1.0), ("a", 20, 2.0)], "k string, avail_ts bigint, v double")
    got = T.asof_grid(obs, ["k"], 12, 0, 10, 60)
    assert rows(got, "t", "v") == [(10, 1.0), (20, 2.0), (30, 2.0)]


def test_interpolation_needs_both_sides(spark):
    p = spark.createDataFrame([("s", "x", 3600, 3600, 10.0), ("s", "x", 14400, 14400, 10.0)], "source string, symbol string, hour bigint, ts bigint, price double")
    base = spark.createDataFrame([("s", "b", 3600, 1800, 2.0), ("s", "b", 7200, 5400, 4.0)], "source string, symbol string, hour bigint, ts bigint, price double")
    assert rows(T.interp_ratio(p, base), "hour", "base_price") == [(3600, 3.0)]


def test_trailing_median_leaves_the_current_row_out(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 9, 3, 100])], "k string, ts bigint, v double")
    got = df.withColumn("m", T.trailing_median("v", 3, 2, ["k"])).orderBy("ts").collect()
    assert [r.m for r in got] == [None, None, 5.0, 3.0]


def test_labels_mask_runup_inside_and_censored(spark):
    rules = Rules(horizons=(2,))
    d = frame(spark, [0.0] * 6).withColumn("dev", F.col("dev_obs"))
    eps = spark.createDataFrame([("a", 3 * HOUR, 3 * HOUR, "", False, None)], "symbol string, t0 bigint, t1 bigint, suspect string, dropped boolean, death bigint")
    got = E.labels(d, eps, rules).orderBy("ts").collect()
    assert [r.y2 for r in got] == [0, 1, 1, None, None, None]
    assert [r.in_episode for r in got] == [0, 0, 0, 1, 0, 0]


def test_quality_flags_and_collapse(spark):
    rules = Rules()
    cols = "symbol string, t0 bigint, t1 bigint, confirmed_at bigint, hours_below bigint, min_dev double, held_min_dev double, hours_beyond_dead bigint, ongoing boolean"
    eps = spark.createDataFrame([
        ("a", 0, 5 * HOUR, 0, 3, -0.4, -0.1, 0, False), ("b", 10 * HOUR, 10 * HOUR, 0, 1, -0.06, None, 0, False),
        ("c", 10 * HOUR, 10 * HOUR, 0, 1, -0.06, None, 0, False), ("d", 10 * HOUR, 10 * HOUR, 0, 1, -0.06, None, 0, False),
        ("e", 0, 90 * HOUR, 0, 60, -0.7, -0.6, 30, False), ("e", 200 * HOUR, 220 * HOUR, 0, 9, -0.2, -0.2, 0, True)], cols)
    got = {(r.symbol, r.t0): (r.suspect, r.dropped, r.terminal) for r in E.quality(eps, rules).collect()}
    assert got[("a", 0)][0] == "snapback" and got[("b", 10 * HOUR)][0] == "same_hour_cluster"
    assert got[("e", 0)] == ("", False, True) and got[("e", 200 * HOUR)] == ("", True, False)


def test_rolling_features_do_not_look_ahead(spark):
    rng = random.Random(5)
    v = [rng.uniform(-2, 1) if rng.random() > 0.1 else None for _ in range(200)]
    changed = v[:120] + [-x if x is not None else 1.0 for x in v[120:]]
    make = lambda vals: spark.createDataFrame([("a", i * HOUR, x) for i, x in enumerate(vals)], "symbol string, ts bigint, z double")
    before = X.rolling(make(v)).filter(F.col("ts") < 120 * HOUR).orderBy("ts").collect()
    after = X.rolling(make(changed)).filter(F.col("ts") < 120 * HOUR).orderBy("ts").collect()
    assert before == after


def test_scalar_rules(spark):
    df = spark.range(1).select(
        S.nearest_hour(F.lit(5400)).alias("even"), S.nearest_hour(F.lit(9000)).alias("odd"), S.nearest_hour(F.lit(5399), 1200).alias("far"),
        S.hit_probability(F.lit(2), F.lit(3), F.lit(10)).alias("p"), S.hit_probability(F.lit(9), F.lit(3), F.lit(10)).alias("sure"),
        S.log_add_exp0(F.lit(800.0)).alias("big"), S.bit_set(F.lit("0x12"), F.lit(4)).alias("b4"), S.bit_set(F.lit("0x12"), F.lit(3)).alias("b3"),
        S.known_time(F.lit(0), F.lit(7200)).alias("k"))
    r = df.first()
    assert (r.even, r.odd, r.far) == (7200, 7200, None)
    assert r.p == pytest.approx(1 - (8 * 7 * 6) / (10 * 9 * 8)) and r.sure == 1.0
    assert r.big == 800.0 and r.b4 and not r.b3 and r.k == 7200


def test_margins_by_year_day_and_category(spark):
    eps = spark.createDataFrame([(0, "a"), (3600, "b"), (86400, "a"), (366 * 86400, "a")], "t0 bigint, category string")
    got = {(r.year, r.day, r.category): r.episodes for r in E.year_by_category(eps).collect()}
    assert got[("1970", "1970-01-01", "a")] == 1 and got[("1970", "1970-01-01", "total")] == 2 and got[("1970", "total", "a")] == 2
    assert got[("1970", "total", "total")] == 3 and got[("total", "total", "a")] == 3 and got[("total", "total", "total")] == 4 and len(got) == 15
