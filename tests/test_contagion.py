"""The pair table's features against plain definitions, no look ahead, and the ladder against separate fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pegwatch.operators import contagion as K
from pegwatch.operators import ladder as L
from pegwatch.rules import DAY, HOUR

T0 = 1_700_000_000 // DAY * DAY + 5 * HOUR


def grid(seed=3, hours=900):
    rnd = random.Random(seed)
    rows = []
    for s in ("a", "b", "c"):
        for h in range(hours):
            if rnd.random() < 0.85:
                rows.append((s, T0 + h * HOUR, round(rnd.gauss(0, 0.6), 4)))
    return rows + [("flat", T0 + h * HOUR, 0.25) for h in range(hours)]


EPS = [("a", T0 + 100 * HOUR), ("a", T0 + 101 * HOUR), ("b", T0 + 500 * HOUR), ("a", T0 + 880 * HOUR)]


def frames(spark, rows, eps=EPS):
    return (spark.createDataFrame(rows, "symbol string, ts long, z double"), spark.createDataFrame(eps, "symbol string, tk long"),
            spark.createDataFrame([("a", "ETH"), ("b", "USD"), ("c", "USD"), ("flat", "USD")], "symbol string, peg string"), spark.createDataFrame([("b", "a")], "wrapper string, underlying string"))


def plain(rows, symbol, ts):
    z = {t: v for s, t, v in rows if s == symbol}
    last = lambda n: [z[t] for t in range(ts - (n - 1) * HOUR, ts + 1, HOUR) if t in z]
    day, week = last(24), last(168)
    near = [t for t, v in z.items() if t <= ts and v < -0.5]
    known = [t for s, t in EPS if s == symbol and t <= ts]
    span = min(24, (ts - T0) // HOUR + 1)
    return {"z_now": z.get(ts), "z_min_24h": min(day, default=None), "z_min_168h": min(week, default=None), "z_std_168h": float(np.std(week, ddof=1)) if len(week) >= 6 else None,
            "near_frac_24h": np.mean([v < -0.5 for v in day]) if day else None, "near_miss_168h": float(sum(v < -0.5 for v in week)) if week else None,
            "hours_since_near_miss": min((ts - max(near)) / HOUR, 2160.0) if near else None, "missing_frac_24h": 1 - len(day) / span,
            "episodes_90d": len([t for t in known if t > ts - 90 * DAY]), "episodes_365d": len(known), "hours_since_episode": min((ts - max(known)) / HOUR, 8760.0) if known else None,
            "und_z_now": {t: v for s, t, v in rows if s == "a"}.get(ts) if symbol == "b" else None}


def asked():
    return [(s, T0 + h * HOUR) for s in ("a", "b", "c", "flat") for h in (0, 3, 30, 200, 719, 880)]


def features(spark, rows, eps=EPS):
    z, e, reg, wrap = frames(spark, rows, eps)
    got = K.own_features(spark.createDataFrame(asked() * 2, "symbol string, ts long"), z, e, reg, wrap).collect()
    return {(r["symbol"], r["ts"]): r.asDict() for r in got}


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_own_features_equal_the_definitions(spark):
    rows, got = grid(), None
    got = features(spark, rows)
    assert set(got) == set(asked())
    for key, r in got.items():
        want = plain(rows, *key)
        assert all(close(r[c], v) for c, v in want.items()), (key, {c: (r[c], v) for c, v in want.items() if not close(r[c], v)})


def test_own_features_do_not_look_ahead(spark):
    """Everything after the asked hour changed: the features of that hour stay."""
    rows, cut = grid(), T0 + 719 * HOUR
    later = [(s, t, v if t <= cut else -9.0) for s, t, v in rows]
    eps = [e for e in EPS if e[1] <= cut] + [("b", cut + HOUR)]
    before, after = features(spark, rows), features(spark, later, eps)
    for key in before:
        if key[1] <= cut:
            assert before[key] == after[key]


def test_pair_correlation_equals_numpy(spark):
    rows = grid()
    z = frames(spark, rows)[0]
    pairs = [("s1", a, b, T0 + h * HOUR) for a in ("a", "flat") for b in ("b", "c", "flat") for h in (100, 719, 899) if a != b]
    got = K.pair_correlation(spark.createDataFrame(pairs, "seed_id string, seed string, cand string, tau long"), K.day_lines(z), 720, 240).collect()
    assert len(got) == len(pairs)
    for r in got:
        x, y = ({t: v for s, t, v in rows if s == k and r["tau"] - 719 * HOUR <= t <= r["tau"]} for k in (r["seed"], r["cand"]))
        both = sorted(set(x) & set(y))
        vary = len({x[t] for t in both}) > 1 and len({y[t] for t in both}) > 1
        want = float(np.corrcoef([x[t] for t in both], [y[t] for t in both])[0, 1]) if len(both) >= 240 and vary else None
        assert close(r["dev_corr_30d"], want)


# ------------------------------------------------------------------------------------------------ ladder
COLS = ["u", "v", "w"]


def examples(n=400):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(n, 3))
    y = (rnd.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    rows = [(int(i), f"g{i % 5}", None if i % 17 == 0 else float(x[i, 0]), float(x[i, 1]), None if i % 3 == 0 else float(x[i, 2]), None if i % 50 == 7 else int(y[i])) for i in range(n)]
    return rows


def separate(train, test, cols, C=1.0):
    """One fit by plain gradient steps of Newton on numpy arrays."""
    def table(rows):
        return np.array([[np.nan if r[2 + c] is None else r[2 + c] for c in cols] for r in rows], float)

    a, b, y = table(train), table(test), np.array([r[5] for r in train], float)
    lo, hi, med = np.nanquantile(a, 0.01, axis=0), np.nanquantile(a, 0.99, axis=0), np.nanquantile(a, 0.5, axis=0)
    fill = lambda m: np.where(np.isnan(m), med, np.clip(m, lo, hi))
    a, b = fill(a), fill(b)
    mean, std = a.mean(0), a.std(0)
    a, b = np.c_[(a - mean) / std, np.ones(len(a))], np.c_[(b - mean) / std, np.ones(len(b))]
    w, ridge = np.zeros(a.shape[1]), np.r_[np.full(a.shape[1] - 1, 1 / C), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
    return 1 / (1 + np.exp(-b @ w))


def test_ladder_equals_separate_fits(spark):
    rows = examples()
    frame = spark.createDataFrame(rows, "id long, grp string, u double, v double, w double, y int").repartition(7)
    folds = L.fold_names(frame, "grp")
    tagged = L.tagged(frame, "grp", folds)
    fitted = L.fit_ladder(tagged, {"small": ["u"], "all": COLS}, "y", folds)
    got = {(r["model"], r["id"]): r["score"] for r in fitted.score(tagged, ["id", "y"]).collect()}
    assert len(got) == 2 * len(rows)
    for name, cols in (("small", [0]), ("all", [0, 1, 2])):
        for g in folds:
            train, test = [r for r in rows if r[1] != g and r[5] is not None], [r for r in rows if r[1] == g]
            for r, s in zip(test, separate(train, test, cols), strict=True):
                assert got[name, r[0]] == pytest.approx(s, abs=1e-7)
    for r in fitted.fits(spark).collect():
        assert r["expected"] == pytest.approx(r["positives"], abs=1e-4) and not r["single_class"]


def test_ladder_of_a_single_class_scores_its_mean(spark):
    frame = spark.createDataFrame([(i, "a" if i < 5 else "b", float(i), int(i < 5)) for i in range(10)], "id long, grp string, u double, y int")
    tagged = L.tagged(frame, "grp", ["a", "b"])
    fitted = L.fit_ladder(tagged, {"m": ["u"]}, "y", ["a", "b"])
    assert {(r["id"], r["score"]) for r in fitted.score(tagged, ["id"]).collect()} == {(i, 0.0 if i < 5 else 1.0) for i in range(10)}
    assert all(r["single_class"] for r in fitted.fits(spark).collect())
    none = L.fit_ladder(tagged.where(F.lit(False)), {"m": ["u"]}, "y", ["a"])
    assert [r["rows_fit"] for r in none.fits(spark).collect()] == [0]
