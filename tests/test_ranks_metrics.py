import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pegwatch.functions.ranks import dense_index, exact_quantiles, ranked, running_totals, top_rows
from pegwatch.operators import metrics as M
from pegwatch.operators import models as L
from pegwatch.operators import resample as R
from pegwatch.rules import HOUR


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold most rows."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{i % 5}", 1.0 if rng.random() < 0.4 else round(rng.random() * 50, 2), i) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "g string, v double, i bigint").cache()


def test_quantiles_are_exact_under_skew(skewed):
    rows, df = skewed
    got = {r.g: (r.a, r.b, r.c) for r in exact_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.99}, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == pytest.approx(np.quantile([r[1] for r in rows if r[0] == g], [0.05, 0.5, 0.99]))


def test_quantile_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).collect()[0].m == 3.0


def test_running_totals_equal_a_plain_scan(skewed):
    rows, df = skewed
    run = running_totals(df.groupBy("v").agg(F.count("*").alias("n")), "v", ["n"], descending=True)
    got = {r.v: (r.cum_n, r.all_n) for r in run.collect()}
    for v in {r[1] for r in rows}:
        assert got[v] == (sum(r[1] >= v for r in rows), len(rows))


def test_null_groups_and_values_stay(spark):
    rows = [(None, 1.0, 1), (None, None, 2), ("a", 1.0, 3), ("a", 1.0, 4), (None, 5.0, 5)]
    df = spark.createDataFrame(rows, "g string, v double, i bigint")
    got = {r.i: (r["rank"], r.total) for r in ranked(df, [("v", False), ("i", False)], ["g"]).collect()}
    assert got == {2: (1, 3), 1: (2, 3), 5: (3, 3), 3: (1, 2), 4: (2, 2)}
    run = running_totals(df.groupBy("g", "v").agg(F.count("*").alias("n")), "v", ["n"], ["g"])
    assert sorted((r.g or "", r.v or 0.0, r.cum_n, r.all_n) for r in run.collect()) == [("", 0.0, 1, 3), ("", 1.0, 2, 3), ("", 5.0, 3, 3), ("a", 1.0, 2, 2)]


def test_a_score_shared_by_a_third_of_the_rows(spark):
    df = spark.range(900).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("v"))
    rows = [(r.v, r.i) for r in df.collect()]
    order = {i: k + 1 for k, (v, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {r.i: r["rank"] for r in ranked(df, [("v", True), ("i", False)]).collect()} == order


def test_top_share_breaks_ties_by_the_next_column(skewed):
    rows, df = skewed
    for share in (0.0, 0.05, 0.7, 1.0):
        got = {r.i for r in top_rows(df, [("v", True), ("i", False)], share=share).filter("top").collect()}
        want = sorted(rows, key=lambda r: (-r[1], r[2]))[: round(share * len(rows))]
        assert got == {r[2] for r in want}


def test_top_k_per_group_larger_than_the_group(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("b", 5.0, 3)], "g string, v double, i bigint")
    out = top_rows(df, [("v", True), ("i", False)], k=F.lit(5), by=["g"])
    assert out.filter("top").count() == 3
    assert {r.i: r["rank"] for r in ranked(df, [("v", True), ("i", False)], ["g"]).collect()} == {1: 2, 2: 1, 3: 1}


def test_dense_index(skewed):
    rows, df = skewed
    names = sorted({r[0] for r in rows})
    assert {r.g: r.idx for r in dense_index(df, "g").collect()} == {g: i for i, g in enumerate(names)}


def brute_ap(y, s):
    out, prev, P = 0.0, 0.0, sum(y)
    for cut in sorted(set(s), reverse=True):
        keep = [a for a, b in zip(y, s, strict=True) if b >= cut]
        out += (sum(keep) / P - prev) * sum(keep) / len(keep)
        prev = sum(keep) / P
    return out


def test_average_precision_auc_and_weights(spark):
    rng = random.Random(3)
    y = [int(rng.random() < 0.3) for _ in range(200)]
    s = [round(rng.random(), 1) for _ in y]
    w = [rng.randint(0, 3) for _ in y]
    df = spark.createDataFrame(list(zip(y, s, w, strict=True)), "y int, score double, w int")
    assert M.average_precision(df).first().ap == pytest.approx(brute_ap(y, s))
    assert M.average_precision(df, weight="w").first().ap == pytest.approx(
        brute_ap([a for a, k in zip(y, w, strict=True) for _ in range(k)], [a for a, k in zip(s, w, strict=True) for _ in range(k)]))
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.auc(df).first().auc == pytest.approx(want)


def test_events_lead_and_runs(spark):
    rows = spark.createDataFrame([("a", h * HOUR, int(4 <= h < 10), h in (4, 5, 8)) for h in range(20)], "symbol string, ts bigint, y int, alert boolean")
    eps = spark.createDataFrame([("a", 10 * HOUR, "major"), ("a", 500 * HOUR, "minor")], "symbol string, t0 bigint, severity string")
    hit = M.episode_hits(rows, eps, 6).collect()
    assert [(r.w, r.caught, r.lead_h, r.severe) for r in hit] == [(6, True, 6.0, True)]
    assert sorted((r.start, r.hours, r.y) for r in M.runs(rows.filter("alert")).collect()) == [(4 * HOUR, 2, 1), (8 * HOUR, 1, 1)]


def test_bootstrap_draws_repeat_and_add_up(spark):
    df = spark.createDataFrame([(f"c{i % 7}", float(i)) for i in range(50)], "c string, v double")
    one = {(r.draw, r.c): r.weight for r in R.draw_weights(df, "c", 5).collect()}
    two = {(r.draw, r.c): r.weight for r in R.draw_weights(df.repartition(3), "c", 5).collect()}
    assert one == two and all(sum(v for (d, _), v in one.items() if d == k) == 7 for k in range(5))


def test_ranking_by_hand(spark):
    pairs = spark.createDataFrame([("s", f"c{i:02d}", 0, 1.0 - i / 20, int(i in (0, 6))) for i in range(12)], "seed_id string, cand string, cluster int, score double, y168 int")
    r = M.ranking(pairs, []).first()
    gain = 1 + 1 / np.log2(8)
    assert (r.p5, r.hit5, r.followers) == (0.2, 1.0, 2)
    assert r.ap == pytest.approx((1 + 2 / 7) / 2) and r.ndcg10 == pytest.approx(gain / (1 + 1 / np.log2(3)))


def test_planted_effect_and_separation_of_null(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        x, z = rng.normal(), rng.normal()
        rows.append((f"g{i % 40}", float(x), float(z), int(rng.random() < 1 / (1 + np.exp(1 - 1.5 * x)))))
    df = spark.createDataFrame(rows, "g string, x double, z double, y int")
    got = {r.feature: r for r in L.robust_cov(df, ["x", "z"], "y", "g", ["x"]).collect()}
    assert got["x"].p < 1e-6 and got["x"].odds_ratio > 2 and got["z"].p > 0.01 and got["x"].wald_p < 1e-6
    assert L.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-4)


def test_winsor_keeps_the_range_of_a_rare_feature(spark):
    df = spark.createDataFrame([(float(i == 7), float(i)) for i in range(300)], "rare double, x double")
    got = {r.measure: (r.low, r.high) for r in L.column_bounds(df, ["rare", "x"], 0.01, 0.99).collect()}
    assert got["rare"] == (0.0, 1.0) and got["x"] == pytest.approx((2.99, 296.01))
    assert L.drop_collinear(df.withColumn("twice", F.col("x") * 2).withColumn("one", F.lit(1.0)), ["x", "twice", "rare", "one"]) == ["x", "rare"]


def test_placebo_hours_far_from_every_seed_are_calm(spark):
    day = 86400
    dev = spark.createDataFrame([(s, h * HOUR, -0.1, "USD") for s in ("a", "b") for h in range(24 * 60)], "symbol string, ts bigint, dev double, peg string")
    seeds = spark.createDataFrame([("a@1", "a", 30 * day, 30 * day, 0, "major", "x", "USD")], "seed_id string, seed string, seed_t0 bigint, tau bigint, cluster bigint, seed_severity string, seed_category string, seed_peg string")
    eps = spark.createDataFrame([("b", 35 * day, 35 * day + 5 * HOUR, False)], "symbol string, t0 bigint, t1 bigint, terminal boolean")
    out = {(r["shift"], r.calm, r.y168) for r in R.placebo_pairs(seeds, eps, dev, (-14, -3, 14)).collect()}
    assert out == {(-14, True, 0), (-3, False, 0), (14, True, 0)}


def test_exponential_variance_of_a_long_series(spark):
    rng = np.random.default_rng(1)
    resid = rng.normal(0, 1, 12_500)
    df = spark.createDataFrame([("a", i, float(r)) for i, r in enumerate(resid)], "symbol string, ts bigint, resid double")
    v = float(np.median(resid[:101] ** 2))
    want = []
    for r in resid:
        v = 0.94 * v + 0.06 * r * r
        want.append(v)
    got = [r.variance for r in L.ewma(df, 100).orderBy("ts").select("variance").collect()]
    assert got == pytest.approx(want, rel=1e-9)


def test_bootstrap_by_arrays_equals_the_joined_draws(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(12)}", rng.choice("ab"), int(rng.random() < 0.2), round(rng.random(), 1)) for _ in range(600)]
    df = spark.createDataFrame(rows, "c string, m string, y int, score double")
    both = [{(r.m, r.draw): r.ap for r in R.bootstrap_ap(df, "c", 40, by=["m"], most=most).collect()} for most in (10**6, 0)]
    assert both[0].keys() == both[1].keys()
    assert list(both[0].values()) == pytest.approx([both[1][k] for k in both[0]])
