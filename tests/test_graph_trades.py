from pyspark.sql import functions as F

from pegwatch.operators import crosscheck as C
from pegwatch.operators import graph as G
from pegwatch.operators import tables as B
from pegwatch.operators import trades as D
from pegwatch.rules import DAY, HOUR, ZERO_ADDRESS, Rules
from pegwatch.sources import scans, schemas, sinks

TOKENS = "address string, symbol string, role string, decimals int, peg string"


def test_trades_by_hand(spark):
    tokens = spark.createDataFrame([("0xa", "AAA", "asset", 2, "USD"), ("0xe", "EEE", "asset", 2, "ETH"), ("0xq", "QQQ", "quote", 2, "USD")], TOKENS)
    t = [(1, "0xa", "pool", "bob", "1000"), (1, "0xq", "bob", "pool", "990"),           # plain swap
         (2, "0xa", ZERO_ADDRESS, "bob", "500"), (2, "0xq", "bob", "pool", "500"),       # mint
         (3, "0xe", "pool", "bob", "500"), (3, "0xq", "bob", "pool", "500"),             # other peg
         (4, "0xa", "pool", "bob", "1"), (4, "0xq", "bob", "pool", "1"),                 # dust
         (5, "0xa", "pool", "bob", "x"), (5, "0xq", "bob", "pool", "500")]               # unreadable
    rows = spark.createDataFrame([(b, 0, 100 + b, *r) for b, *r in t], schemas.TRANSFERS)
    out = D.dedupe_trades(D.pair_trades(D.priced_transfers(rows, tokens), tokens, {"USD": 1.0, "ETH": 0.1})).collect()
    assert [(r.block_number, r.symbol, r.quote, r.asset_amount, r.quote_amount, r.n_parties) for r in out] == [(1, "AAA", "QQQ", 10.0, 9.9, 2)]


def test_hourly_quartiles_and_collapse(spark):
    rows = spark.createDataFrame([("A", "USD", q, i, p * 10.0, 10.0, 1) for q, i, p in (("x", 1, 1.0), ("x", 2, 2.0), ("x", 3, 4.0), ("y", 4, 3.0))],
                                 "symbol string, peg string, quote string, ts bigint, quote_amount double, asset_amount double, n_parties bigint")
    h = {r.quote: r for r in D.hourly_prices(rows, {"USD": 1.0}).collect()}
    assert (h["x"].p25, h["x"].p50, h["x"].p75, h["x"].n_trades) == (1.5, 2.0, 3.0, 3)
    c = D.collapse_quotes(D.hourly_prices(rows, {"USD": 1.0})).first()
    assert (c.price, c.high, c.n_quotes, c.n_trades) == (2.5, 3.0, 2, 4)
    assert D.collapse_quotes(spark.createDataFrame([("A", 0, 1.0)], "symbol string, ts bigint, price double")).first().high == 1.0


def test_closure_and_components(spark):
    static = spark.createDataFrame([("b", "a", "w"), ("c", "b", "w"), ("e", "d", "w"), ("f", "d", "w")], "src string, dst string, etype string")
    assert {(r.root, r.member) for r in G.closure(static).collect()} == {("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("d", "f")}
    nodes = spark.createDataFrame([("a",), ("z",)], "node_id string")
    assert {(r.node, r.family) for r in G.components(static, nodes).collect()} == {
        ("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d"), ("z", "z")}


def test_bad_debt_freezes_and_unverifiable_is_left_out(spark):
    cols = "t bigint, market_id string, collateral string, loan string, lltv double, oracle_class string, collateralAssets double, supplyAssetsUsd double, borrowAssetsUsd double, collateralAssetsUsd double"
    bad = [(d * DAY, "m", "c", "l", 0.9, "feed", 1.0, 4e5 * (d + 1), 3e5 * (d + 1), 1e5 if d != 3 else None) for d in range(6)]
    loop = [(d * DAY, "n", "c", "l", 0.9, "feed", 1.0, 2e6, 2e6, None) for d in range(4)]
    out = {(r.market_id, r.t // DAY): r for r in G.clean_markets(spark.createDataFrame(bad + loop, cols)).collect()}
    assert [out[("m", d)].flag for d in range(6)] == ["", "", *["bad_debt_freeze"] * 4]
    assert out[("m", 5)].borrowAssetsUsd == 3e5 and out[("m", 1)].borrowAssetsUsd == 6e5
    assert [out[("n", d)].flag for d in range(4)] == ["", "", "unverifiable", "unverifiable"] and out[("n", 3)].supplyAssetsUsd is None
    va = spark.createDataFrame([(2 * DAY, "v", "m", "f", 50.0), (0, "v", "m", "f", 30.0), (2 * DAY, "v", "", "f", 80.0)], "t bigint, vault string, market_id string, field string, value double")
    kept = {(r.market_id, r.t // DAY): r.value for r in G.clean_vaults(va, G.clean_markets(spark.createDataFrame(bad, cols))).collect()}
    assert kept == {("m", 2): 30.0, ("m", 0): 30.0, ("", 2): 60.0}


def test_pair_links_by_hand(spark):
    e = [(0, "tok:A", "mm:1", "collateral", 10.0, None), (0, "mm:1", "tok:B", "borrow", 7.0, None), (0, "mv:x", "mm:1", "allocation", 3e4, None),
         (0, "tok:B", "mm:2", "collateral", 5.0, None), (0, "mm:2", "tok:C", "borrow", 2.0, None), (0, "mv:x", "mm:2", "allocation", 2e4, None),
         (0, "tok:A", "pool:p", "pool_supply", 9.0, 0.8), (0, "tok:B", "pool:p", "pool_supply", 4.0, 0.8), (0, "pool:p", "tok:B", "pool_borrow", 6.0, None)]
    edges = spark.createDataFrame(e, "t bigint, src string, dst string, etype string, usd double, liq_threshold double").withColumn("emode_ltv", F.lit(0.0))
    fam = spark.createDataFrame([(f"tok:{x}", f"tok:{x}") for x in "ABC"], "node string, family string")
    pairs = spark.createDataFrame([("tok:A", "tok:B", 5), ("tok:B", "tok:A", 5), ("tok:A", "tok:A", 5), ("tok:A", "tok:B", -1)], "seed string, cand string, tau bigint")
    got = {(r.seed[-1], r.cand[-1], r.tau): r for r in G.pair_links(edges, fam, pairs).collect()}
    ab = got[("A", "B", 5)]
    expm1 = lambda x: round(__import__("math").expm1(x), 6)
    assert (expm1(ab.log_lend_cand_vs_seed), expm1(ab.log_lend_seed_vs_cand), expm1(ab.log_vault_overlap), ab.shared_vaults) == (7.0, 0.0, 2e4, 1)
    assert (round(ab.vault_share, 6), expm1(ab.log_pool_overlap), expm1(ab.log_pool_lend_cand_vs_seed)) == (0.6, 4.0, 6.0)
    assert expm1(got[("B", "A", 5)].log_lend_seed_vs_cand) == 7.0 and got[("A", "A", 5)].same_family == 1
    assert got[("A", "A", 5)].log_pool_overlap == 0.0 and got[("A", "B", -1)].log_vault_overlap == 0.0


def test_oracle_classes(spark):
    m = spark.createDataFrame([("none", "", True, "", "X"), ("custom", "0x1", False, "", "X"), ("fixed", "0x1", True, "", "X"), ("vault", "0x1", True, "0x2", "X"),
                               ("rate", "0x1", True, "", "X"), ("ref", "0x1", True, "", "X"), ("self", "0x1", True, "", "WETH"), ("market", "0x1", True, "", "X")],
                              "market_id string, oracle_address string, standard boolean, base_vault string, collateral_symbol string")
    f = spark.createDataFrame([("rate", "weETH/ETH exchange rate"), ("rate", "ETH / USD"), ("ref", "USDC/USD"), ("self", "ETH / USD"), ("market", "STETH / USD")], "market_id string, description string")
    assert {r.market_id: r.oracle_class for r in G.classify(m, f).collect()} == {
        "none": "none", "custom": "custom", "fixed": "fixed", "vault": "vault_rate", "rate": "rate_feed", "ref": "fixed", "self": "feed", "market": "feed"}


def test_check_status_and_second_only(spark):
    rules = Rules(min_run=1)
    eps = spark.createDataFrame([("a", 10 * HOUR, 12 * HOUR, 0.01), ("b", 10 * HOUR, 12 * HOUR, 0.01), ("c", 10 * HOUR, 12 * HOUR, 0.01)], "symbol string, t0 bigint, t1 bigint, theta double")
    sec = [("a", h * HOUR, -0.02, -0.02, 5) for h in range(9, 13)] + [("b", h * HOUR, 0.001, 0.001, 5) for h in range(9, 13)]
    second = spark.createDataFrame(sec, "symbol string, ts bigint, mid double, high double, n bigint")
    assert {r.symbol: r.status for r in C.check(eps, second, rules).collect()} == {"a": "confirmed", "b": "contradicted", "c": "unverified"}
    only = C.second_only(second.withColumn("theta", F.lit(0.01)), eps.filter("symbol = 'z'"), rules).collect()
    assert [(r.symbol, r.t0, r.trades) for r in only] == [("a", 9 * HOUR, 20)]


def test_candidates_exclude_busy_dead_and_silent_assets(spark):
    seeds = spark.createDataFrame([("s@0", "s", 100 * HOUR)], "seed_id string, seed string, tau bigint")
    eps = spark.createDataFrame([("busy", 90 * HOUR, 95 * HOUR, 91 * HOUR, False), ("dead", 10 * HOUR, 12 * HOUR, 11 * HOUR, True), ("next", 120 * HOUR, 121 * HOUR, 121 * HOUR, False),
                                 ("done", 50 * HOUR, 76 * HOUR, 51 * HOUR, False)], "symbol string, t0 bigint, t1 bigint, tk bigint, terminal boolean")
    dev = spark.createDataFrame([(x, 99 * HOUR, 0.0) for x in ("s", "busy", "dead", "next", "done")] + [("old", 60 * HOUR, 0.0), ("next", 400 * HOUR, 0.0)], "symbol string, ts bigint, dev double")
    assert {(r.cand, r.y72, r.y168) for r in B.candidates(seeds, eps, dev).collect()} == {("next", 1, 1), ("done", 0, 0)}


def test_clusters_stay_together_at_exactly_the_gap(spark):
    t = spark.createDataFrame([(0,), (72 * HOUR,), (145 * HOUR,)], "tau bigint")
    assert {r.tau // HOUR: r.cluster for r in B.clusters(t, "tau").collect()} == {0: 0, 72: 0, 145: 1}


def test_scans_and_upsert(spark, tmp_path):
    assert scans.read_table(spark, str(tmp_path / "absent"), schemas.RATES).count() == 0
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "symbol string, price double")
    sinks.write_csv(df, str(tmp_path / "p.csv.gz"))
    back = scans.read_csv(spark, str(tmp_path / "p.csv"), schemas.PRICES, ["symbol", "price", "confidence"])
    assert {(r.symbol, r.price, r.confidence) for r in back.collect()} == {("a", None, None), ("b", 1.0, None)}
    old, new = spark.createDataFrame([("m", 1), ("k", 2)], "key string, v int"), spark.createDataFrame([("m", 9)], "key string, v int")
    assert {(r.key, r.v) for r in sinks.upsert(old, new, ["key"]).collect()} == {("m", 9), ("k", 2)}


def test_edges_are_written_by_day_above_the_floor(spark, tmp_path):
    from pegwatch.sources.sinks import write_edges

    day = 86400
    rows = [(d * day + 5, f"s{i}", "m", "supply", float(i), None) for d in range(2) for i in range(5)] + [(9, "s", "m", "borrow", None, 3.0), (9, "s", "m", "borrow", None, 0.0)]
    df = spark.createDataFrame(rows, "t bigint, src string, dst string, etype string, usd double, tokens double")
    write_edges(df, f"{tmp_path}/edges", 2.0)
    back = spark.read.parquet(f"{tmp_path}/edges")
    assert {(str(r.day), r.src, r.usd) for r in back.collect()} == {(f"1970-01-0{d + 1}", f"s{i}", float(i)) for d in range(2) for i in (2, 3, 4)} | {("1970-01-01", "s", None)}


def test_allocations_are_moved_by_vault_and_by_market_once(spark):
    """Joins of allocations by whole digests, and again for every use, made the shuffles grow faster than the input."""
    from pegwatch.plans import q_graph as Q

    sf = "/root/testdata/sf0.001"
    plan = Q.vault_history(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(concat(0xv") == 1 and "Exchange hashpartitioning(vault" not in plan and "md5" not in plan
    held, market = Q.held_allocations(spark, sf), Q.cleaned(spark, sf)
    assert {len(r.market_id) for r in held.select("market_id").distinct().collect()} <= {0, 1, 2}
    made = Q.edges.build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in made and "HashJoin" not in made
    assert held.filter("market_id <> '' and not listed").isEmpty() and held.filter("market_id <> ''").join(market, ["market_id", "t"], "left_anti").isEmpty()


def test_transfers_are_moved_by_block_once(spark):
    """A constant in the account key hid how the entries were dealt, so they were moved four times."""
    from pegwatch.plans import standins as T

    plan = T.trades.build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(l_orderkey" in plan


def test_market_tokens_and_edge_counts_write_no_more_than_they_read(spark):
    """The market tokens had every vault's allocations and all edges written first, the edge counts all edges."""
    from pegwatch import session
    from pegwatch.plans import catalog

    data = "/root/testdata/sf0.001"
    written = lambda: {name for _, folder, name in session._STAGES if folder == data}
    session.forget_stages()
    catalog.QUERIES["d16_market_mode"](spark, data).count()
    assert "cleaned" in written() and not written() & {"allocations", "held_allocations", "edges"}
    catalog.QUERIES["a12_edge_counts"](spark, data).count()
    catalog.QUERIES["a12_edge_sink"](spark, data).count()
    assert "held_allocations" in written() and "edges" not in written()
    session.forget_stages()


def test_links_from_snapshots_equal_those_from_edges(spark):
    """Links had the allocations and edges of every snapshot judged and written, though only those of the asked snapshots enter them."""
    d, markets = 86400, spark.createDataFrame([("m", "mm:m", "A", "B"), ("f", "mm:f", "A", "B"), ("k", "mm:k", "B", "A")], "market_id string, node string, collateral string, loan string")
    row = lambda t, m, c, x, flag="", began=None: (t * d, m, f"mm:{m}", c, x, 0.5, "feed", 1.0, 9e4, 2e4, 9e4, flag, began)
    mm = spark.createDataFrame([row(t, "m", "A", "B") for t in (1, 2, 3)] + [row(1, "f", "A", "B"), row(2, "f", "A", "B"), row(3, "f", "A", "B", "bad_debt_freeze", d)]
                               + [row(t, "k", "B", "A", "unverifiable" if t == 2 else "") for t in (1, 2, 3)],
                               "t bigint, market_id string, m_node string, collateral string, loan string, lltv double, oracle_class string, collateralAssets double, "
                               "supplyAssetsUsd double, borrowAssetsUsd double, collateralAssetsUsd double, flag string, frozen_from bigint")
    va = spark.createDataFrame([(t * d, v, m, "Usd", "B", 1e4 * t + i) for t in (1, 2, 3, 5, 6) for i, (v, m) in enumerate([("v", "m"), ("v", "f"), ("v", "k"), ("w", "f"), ("w", "k"), ("v", ""), ("w", "")])
                                if t < 5 or (t, m) in ((5, "m"),)] + [(6 * d, "v", "unknown", "Usd", "B", 5.0)], "t bigint, vault string, market_id string, field string, asset string, value double")
    aa = spark.createDataFrame([(t * d, "p", x, 10.0 * t, 5.0, 4.0, 0.5, 0.6, 0.0, 0) for t in (1, 3) for x in "AB"],
                               "t bigint, pool string, asset string, supply_usd double, supply double, debt_usd double, ltv double, liq_threshold double, emode_ltv double, frozen_any int")
    fam = spark.createDataFrame([(f"tok:{x}", f"tok:{x}") for x in "AB"], "node string, family string")
    pairs = spark.createDataFrame([(f"tok:{a}", f"tok:{b}", t * d + 5) for a in "AB" for b in "AB" for t in (0, 2, 3, 5, 6)], "seed string, cand string, tau bigint")
    node = F.concat(F.lit("mv:"), "vault")
    held = G.clean_vaults(va, mm, markets)
    want = G.pair_links(G.edges(mm, held, aa, node), fam, pairs)
    got = G.snapshot_links(mm, va, aa, markets, node, fam, pairs)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(got) == rows(want) and any(r.log_vault_overlap > 0 for r in got.collect())
    asked = spark.createDataFrame([(3 * d,)], "t bigint")
    assert rows(G.asked_allocations(va, mm, asked, markets).select("t", "vault", "market_id", "flag", "value")) == rows(
        held.filter((F.col("t") == 3 * d) & (F.col("market_id") != "")).select("t", "vault", "market_id", "flag", "value"))


def test_pair_links_write_no_whole_edges(spark):
    from pegwatch import session
    from pegwatch.plans import catalog

    data = "/root/testdata/sf0.001"
    session.forget_stages()
    catalog.QUERIES["h6_h9_pair_links"](spark, data).count()
    assert not {name for _, folder, name in session._STAGES if folder == data} & {"edges", "held_allocations"}
    session.forget_stages()


def test_allocations_are_sorted_once_by_vault(spark):
    from pegwatch.plans import q_graph as Q

    plan = Q.allocations.build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [_key") == 1 and "Sort [vault" not in plan


def test_the_greatest_of_one_time_holds_on_the_grid(spark):
    from pegwatch.operators.series import asof_grid

    rows = [("a", 1, 0, 5.0), ("a", 1, 1, 2.0), ("a", 1, 1, 3.0), ("a", 4, 0, 7.0), ("a", 4, 0, 7.0), ("b", 2, 0, 1.0), ("b", 2, 1, None)]
    obs = spark.createDataFrame(rows, "k string, avail_ts bigint, prio int, value double")
    want = asof_grid(G.finest(obs, ["k"]), ["k"], 3, 0, 1, 6)
    got = asof_grid(obs, ["k"], 3, 0, 1, 6, rank=G.FINEST).select("k", "value", "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("k", "value", "t").collect())) and got.count() == 10


def test_the_blind_share_needs_no_allocations(spark, monkeypatch):
    """All measures with the vaults' allocations were made and written for the one share of the collateral side."""
    from pegwatch import session
    from pegwatch.plans import q_graph

    def never(*_):
        raise AssertionError("not needed")

    for name in ("allocations", "held_allocations", "pools", "measures"):
        monkeypatch.setattr(q_graph, name, never)
    session.forget_stages()
    got = q_graph.d13(spark, "/root/testdata/sf0.001")
    assert got.columns == ["symbol", "t", "share"] and got.filter("share between 0 and 1").count() == got.count() > 0
