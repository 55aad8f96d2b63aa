"""Queries on the contagion pair table, its rankers and the ladder of models over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pegwatch.operators import contagion as K
from pegwatch.operators import ladder as L
from pegwatch.operators import tables as B
from pegwatch.plans import standins as T
from pegwatch.plans.q_features import rounded, rounds
from pegwatch.plans.q_graph import links
from pegwatch.plans.registry import block, query
from pegwatch.session import staged

MORPHO, POOL = K.GRAPH[:5], K.GRAPH[5:]
COUNTS = ["episodes_90d", "episodes_365d", "same_family", "shared_vaults"]
NUMBERS = [c for c in (*K.OWN, *K.SIM, *K.GRAPH) if c not in COUNTS]


@staged
def contagion_table(spark, sf):
    pairs, z, eps = T.pairs(spark, sf), T.z(spark, sf), T.clean_episodes(spark, sf)
    lines = day_lines(spark, sf)
    own = K.own_features(pairs.select(F.col("cand").alias("symbol"), F.col("tau").alias("ts")), z, eps, T.registry(spark, sf), T.wrapper_pairs(spark, sf), lines)
    return K.contagion_table(pairs, B.follow(pairs, eps), K.pair_correlation(pairs, lines, least=60), links(spark, sf).select("seed_id", F.col("cand_asset").alias("cand"), *K.FAM, *K.GRAPH), own, T.registry(spark, sf))


@staged
def day_lines(spark, sf):
    return K.day_lines(T.z(spark, sf).where("z is not null"))


block("pair_corr", """
SELECT seed_id, cand, CASE WHEN n >= 60 AND sx > 0 AND sy > 0 THEN c END AS dev_corr_30d
FROM pairs LEFT JOIN (
  SELECT seed, tau, cand, count(*) AS n, stddev_pop(x.z) AS sx, stddev_pop(y.z) AS sy, corr(x.z, y.z) AS c
  FROM (SELECT DISTINCT seed, tau, cand FROM pairs) p JOIN z x ON x.symbol = seed AND x.ts BETWEEN tau - 719 * 3600 AND tau
  JOIN z y ON y.symbol = cand AND y.ts = x.ts WHERE x.z IS NOT NULL AND y.z IS NOT NULL GROUP BY ALL) USING (seed, tau, cand)""", ["pairs", "z"])


@query("j21_pair_correlation", "SELECT seed_id, cand, round(dev_corr_30d, 6) AS dev_corr_30d FROM pair_corr", ["pair_corr"])
def j21(spark, sf):
    return rounded(K.pair_correlation(T.pairs(spark, sf), day_lines(spark, sf), least=60), ["seed_id", "cand", "dev_corr_30d"])


block("contagion", """
SELECT p.seed_id, p.seed, p.tau, p.cluster, p.split, p.seed_severity, p.cand, p.y72, p.y168,
  CAST(a.category = b.category AS DOUBLE) AS same_category, CAST(a.peg = b.peg AS DOUBLE) AS same_peg, dev_corr_30d, follow_rate, codepeg_share,
  l.* EXCLUDE (seed_id, cand_asset), z_now, z_min_24h, z_min_168h, z_std_168h, near_frac_24h, near_miss_168h, hours_since_near_miss, missing_frac_24h,
  episodes_90d, episodes_365d, hours_since_episode, CAST(b.peg = 'ETH' AS DOUBLE) AS peg_eth, u.z AS und_z_now
FROM pairs p JOIN registry a ON a.symbol = p.seed JOIN registry b ON b.symbol = p.cand
JOIN pair_corr USING (seed_id, cand) JOIN follow USING (seed_id, cand) JOIN links l ON l.seed_id = p.seed_id AND l.cand_asset = p.cand
JOIN rolling r ON r.symbol = p.cand AND r.ts = p.tau JOIN history h ON h.symbol = p.cand AND h.ts = p.tau
LEFT JOIN z u ON suffix(p.cand, '_1') AND u.symbol = split_part(p.cand, '_', 1) || '_0' AND u.ts = p.tau""", ["pairs", "registry", "pair_corr", "follow", "links", "rolling", "history", "z"])
KEYS = ["seed_id", "cand", "tau", "cluster", "split", "y72", "y168"]


@query("c16_c19_contagion_table", f"SELECT {', '.join(KEYS + COUNTS)}, {rounds(NUMBERS)} FROM contagion", ["contagion"])
def c16(spark, sf):
    return rounded(contagion_table.build(spark, sf), [*KEYS, *COUNTS, *NUMBERS])


@query("c19_contagion_summary", """
SELECT split, count(DISTINCT seed_id) AS seeds, count(DISTINCT cluster) AS clusters, count(*) AS pairs, CAST(sum(y72) AS BIGINT) AS y72, CAST(sum(y168) AS BIGINT) AS y168,
  CAST(sum(CAST(same_family > 0 AS INT)) AS BIGINT) AS same_family FROM contagion GROUP BY split""", ["contagion"])
def c19s(spark, sf):
    return K.group_summary(contagion_table(spark, sf))


def any_link(cols):
    return "(" + " OR ".join(f"{c} > 0" for c in cols) + ")"


@query("c19_linked_pairs", " UNION ALL ".join(
    f"SELECT '{name}' AS source, CAST(coalesce(sum(CAST({any_link(cols)} AS INT)), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(y168) FILTER ({any_link(cols)}), 0) AS BIGINT) AS followed FROM contagion"
    for name, cols in (("any", K.GRAPH), ("market", MORPHO), ("pool", POOL))), ["contagion"])
def c19l(spark, sf):
    return K.linked_pairs(contagion_table(spark, sf), {"any": K.GRAPH, "market": MORPHO, "pool": POOL})


@query("i5_contagion_rankers", """
SELECT seed_id, cand, CAST(coalesce(episodes_365d, 0) AS DOUBLE) AS hist, round(-coalesce(z_min_24h, 0), 6) AS stress, round(follow_rate, 6) AS follow FROM contagion""", ["contagion"])
def i5c(spark, sf):
    return rounded(K.rankers(contagion_table(spark, sf)), ["seed_id", "cand", "hist", "stress", "follow"])


def pair_ladder(spark, sf, fold_of, folds=None):
    rows = contagion_table(spark, sf)
    folds = L.fold_names(rows, fold_of) if folds is None else folds
    rows = L.tagged(rows, fold_of, folds)
    return rows, L.fit_ladder(rows, K.LADDER, "y168", folds)


FITS = ["model", "fold", "rows_fit", "positives", "expected", "single_class"]
MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model" for m in K.LADDER)


def fits_sql(source: str, fold_of: str, y: str, models: str, folds: str | None = None) -> str:
    """A fitted model with a free intercept expects exactly the positives that it was trained on, in every fold."""
    return f"""
SELECT model, fold, rows_fit, positives, round(CAST(positives AS DOUBLE), 3) AS expected, positives IN (0, rows_fit) AS single_class FROM ({models}), (
  SELECT CAST(f.g AS VARCHAR) AS fold, count({y}) FILTER ({fold_of} IS DISTINCT FROM f.g) AS rows_fit, CAST(coalesce(sum({y}) FILTER ({fold_of} IS DISTINCT FROM f.g), 0) AS BIGINT) AS positives
  FROM {source}, ({folds or f"SELECT DISTINCT {fold_of} AS g FROM {source} WHERE {fold_of} IS NOT NULL"}) f GROUP BY f.g)"""


@query("i4_i6_contagion_ladder_fits", fits_sql("contagion", "split", "y168", MODELS, "SELECT 'test' AS g"), ["contagion"])
def i4t(spark, sf):
    _, fitted = pair_ladder(spark, sf, "split", ["test"])
    return rounded(fitted.fits(spark), FITS, 3)


@query("i4_i7_contagion_ladder_fits", fits_sql("contagion", "seed", "y168", MODELS), ["contagion"])
def i4l(spark, sf):
    """Leaves one seed out in turn; the stand-in's seeds are all of one time cluster."""
    _, fitted = pair_ladder(spark, sf, "seed")
    return rounded(fitted.fits(spark), FITS, 3)


@query("i4_i7_contagion_ladder_scores")
def i4s(spark, sf):
    rows, fitted = pair_ladder(spark, sf, "seed")
    return rounded(fitted.score(rows, ["seed_id", "cand", "y168"]), ["model", "seed_id", "cand", "y168", "score"])
