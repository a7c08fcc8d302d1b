"""Global orders, sweeps, cores: against plain loops, and spread over tasks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import random_rows

from tapescope.config import make_config
from tapescope.operators import baselines, causal, economics, graph, jumps, state
from tapescope.operators.running import Track
from tapescope.operators.scan import ranged, ranges
from tapescope.session import cut

HOUR = 3_600_000


@pytest.mark.parametrize("parts", [1, 7])
def test_ranged_matches_a_loop(spark, parts):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, 0.1, 0.5, 0.5, rnd.random()]), rnd.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v double, x long")
    got = ranged(df, ["k"], ["v", "id"], [Track("s", "sum", F.col("x")), Track("m", "max", F.col("x")), Track("p", "last", F.when(F.col("x") > 4, F.col("x")))], parts=parts)
    want = {}
    for key in "ab":
        s, m, p = 0, None, None
        for i, _, _, x in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            want[i] = (s, m, p)
            s, m, p = s + x, x if m is None else max(m, x), x if x > 4 else p
    assert {r.id: (r.s, r.m, r.p) for r in got.collect()} == want


def test_values_of_one_unit_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 7 / 1e9).alias("v"))
    sizes = [r["count"] for r in ranges(df, [], ["v", "id"], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_prior_zscores_in_one_scan(spark, make_tape):
    tape = make_tape(random_rows(200, 8))
    got = state.prior_zscores(tape, [], state.ORDER, {"a": F.col("notional_usdc"), "b": F.col("price")}).orderBy(*state.ORDER).collect()
    for col, name in (("notional_usdc", "a"), ("price", "b")):
        seen = []
        for r in got:
            sd = np.std(seen, ddof=1) if len(seen) > 1 else 0
            assert r[name] == pytest.approx((r[col] - np.mean(seen)) / sd if sd > 1e-12 else 0, abs=1e-6)
            seen.append(r[col])


def test_rank_sums_with_all_returns_in_one_unit(spark):
    rnd = random.Random(2)
    rows = [(1, rnd.randrange(50) / 1e6, rnd.random() < 0.3) for _ in range(400)]
    u = economics.rank_sums(spark.createDataFrame(rows, "market_id int, trade_return double, is_flagged boolean"), ["market_id"]).first()["mann_whitney_u"]
    f, o = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    assert u == sum((a > b) + 0.5 * (a == b) for a in f for b in o)


def test_selection_by_falling_score(spark):
    rows = [(1, f"w{i}", float(i % 5), 10) for i in range(40)]
    df = spark.createDataFrame(rows, "market_id int, wallet string, composite double, n_buys long")
    order = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert {r.wallet for r in baselines.select_until_target(df, F.lit(95)).collect()} == {r[1] for r in order[:10]}
    assert {r.wallet for r in baselines.select_top_percent(df, 20.0).collect()} == {r[1] for r in order[:8]}


# ---- jump boosts by sweep

def copied_boosts(tape, ticks, cfg):
    """Every tick's buffer as its own copy."""
    j, keys = cfg["jumps"], ["market_id", "tick"]
    buffer = causal.rolling_buffer(tape, ticks, int(j["buffer_hours"] * HOUR))
    used = buffer.join(buffer.groupBy(*keys).count().where(F.col("count") >= j["min_buffer_trades"]).select(*keys), keys, "left_semi")
    return jumps.score_jump_wallets(used, jumps.find_jumps(used, cfg, keys), cfg, keys).where("jump_boost > 1.001").select(*keys, "wallet", "jump_boost")


@pytest.mark.parametrize("window,look,hours,least", [(30, 60, 24, 0.0), (10, 20, 2, 2000.0), (60, 120, 2, 0.0), (1, 1, 1, 0.0)])
def test_tick_boosts_equal_copied_buffers(spark, make_tape, window, look, hours, least):
    cfg = make_config(jumps={"jump_window_minutes": window, "pre_jump_lookback_minutes": look, "buffer_hours": hours, "min_trade_notional": least, "min_buffer_trades": 5})
    tape = make_tape(random_rows(400, window + hours))
    ticks = tape.where("seq % 9 = 4").groupBy("market_id", F.col("timestamp_ms").alias("tick")).agg(F.max("timestamp_ms").alias("tick_ms"))
    got = {(r.market_id, r.tick, r.wallet): r.jump_boost for r in causal.tick_boosts(tape, ticks, cfg, chunk_ms=HOUR).collect()}
    want = {(r.market_id, r.tick, r.wallet): r.jump_boost for r in copied_boosts(tape, ticks, cfg).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("asked", [False, True])
def test_tick_boosts_copy_no_trade_to_its_ticks(spark, make_tape, monkeypatch, asked):
    """Jumps that stay open longer than the buffer lasts, as in the registered queries."""
    cfg = make_config(jumps={"jump_window_minutes": 90, "pre_jump_lookback_minutes": 150, "buffer_hours": 2, "min_buffer_trades": 5})
    tape = make_tape(random_rows(400, 17))
    ticks = tape.where("seq % 9 = 4").groupBy("market_id", F.col("timestamp_ms").alias("tick")).agg(F.max("timestamp_ms").alias("tick_ms"))
    want = {(r.market_id, r.tick, r.wallet): r.jump_boost for r in copied_boosts(tape, ticks, cfg).collect()}
    pairs = ticks.select("market_id", "tick").join(tape.select("market_id", "wallet").distinct(), "market_id") if asked else None
    monkeypatch.setattr(causal, "rolling_buffer", None)
    got = {(r.market_id, r.tick, r.wallet): r.jump_boost for r in causal.tick_boosts(tape, ticks, cfg, pairs, chunk_ms=HOUR).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_buffer_totals_equal_copies(make_tape):
    tape = make_tape(random_rows(200, 4))
    ticks = tape.where("seq % 5 = 0").groupBy("market_id", F.col("timestamp_ms").alias("tick")).agg(F.max("timestamp_ms").alias("tick_ms"))
    want = causal.rolling_buffer(tape, ticks, HOUR).groupBy("market_id", "tick").agg(F.count("*").alias("n"), F.sum("notional_usdc").alias("x")).collect()
    got = {(r.market_id, r.tick): (r.n, r.notional) for r in causal.buffer_totals(tape, ticks, 1, 60_000).collect()}
    assert {k: v[0] for k, v in got.items()} == {(r.market_id, r.tick): r.n for r in want}
    assert all(got[r.market_id, r.tick][1] == pytest.approx(r.x) for r in want)


# ---- cores

def brute_core(edges, k):
    edges = set(edges)
    while True:
        degree = {}
        for a, b in edges:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        left = {(a, b) for a, b in edges if degree[a] >= k and degree[b] >= k}
        if left == edges:
            return edges
        edges = left


@pytest.mark.parametrize("k,task_edges", [(2, 500_000), (3, 500_000), (2, 40), (3, 10)])
def test_k_core_against_brute_force(spark, k, task_edges):
    rnd = random.Random(k)
    want, rows = set(), []
    for market in (1, 2):
        pairs = {tuple(sorted(rnd.sample(range(40 * c, 40 * c + 40), 2))) for c in range(4) for _ in range(12 + 25 * c)}
        rows += [(market, f"n{a}", f"n{b}", 1.0) for a, b in pairs]
        want |= {(market, f"n{a}", f"n{b}") for a, b in brute_core(pairs, k)}
    got = graph.k_core(spark.createDataFrame(rows, "market_id int, src string, dst string, weight double"), k, task_edges=task_edges)
    assert {(r.market_id, r.src, r.dst) for r in got.collect()} == want


def test_a_long_chain_is_peeled_in_few_jobs(spark):
    rows = [(1, f"n{i:04d}", f"n{i + 1:04d}", 1.0) for i in range(1000)] + [(1, "n0000", "t1", 1.0), (1, "t1", "t2", 1.0), (1, "n0000", "t2", 1.0)]
    df = spark.createDataFrame(rows, "market_id int, src string, dst string, weight double")
    spark.sparkContext.setJobGroup("core", "core")
    core = graph.k_core(df, 2).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("core")
    assert {(r.src, r.dst) for r in core} == {("n0000", "t1"), ("t1", "t2"), ("n0000", "t2")} and len(jobs) < 150


# ---- busy slots

def test_busy_hour_is_spread_and_exact(spark, make_tape):
    rnd = random.Random(9)
    rows = [(rnd.randrange(3_000_000, 6_500_000), f"w{rnd.randrange(30)}", rnd.randrange(2), rnd.choice(["BUY", "SELL"]), 0.5, rnd.randrange(100, 9000)) for _ in range(300)]
    rows += [(7_300_000, "w1", 0, "BUY", 0.5, 500), (7_300_000, "w2", 0, "BUY", 0.5, 500), (20_000_000, "w3", 0, "BUY", 0.5, 500)]
    cfg = make_config()
    c, tape, want = cfg["clustering"], make_tape(rows), {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            gap = abs(a[0] // 1000 - b[0] // 1000)
            if a[1] != b[1] and gap <= c["max_time_window"]:
                w = (1 - gap / c["max_time_window"]) * min((a[5] * b[5]) ** 0.5 / c["size_normalizer"], c["max_size_mult"])
                w *= (c["same_direction_mult"] if a[3] == b[3] else 1) * (c["cross_outcome_penalty"] if a[2] != b[2] else 1)
                want[tuple(sorted((a[1], b[1])))] = want.get(tuple(sorted((a[1], b[1]))), 0) + w
    for block in (16, 10_000):
        got = {(r.src, r.dst): r.weight for r in graph.theta_graph(tape, cfg, block=block).collect()}
        assert got.keys() == {k for k, v in want.items() if v > 0} and all(got[k] == pytest.approx(want[k]) for k in got)
    pairs = graph.band_pairs(tape, 3600, ["market_id"], 16)
    plan = pairs._jdf.queryExecution().toString()
    assert "_ga" in plan and "_gb" in plan  # groups are part of the join key


@pytest.mark.parametrize("look", [10, 60])
def test_next_jump_against_brute_force(spark, make_tape, look):
    cfg = make_config(jumps={"pre_jump_lookback_minutes": look, "jump_window_minutes": 20, "jump_threshold": 0.3})
    tape = make_tape(random_rows(250, look))
    found = jumps.find_jumps(tape, cfg).collect()
    for r in jumps.next_jump(tape, jumps.find_jumps(tape, cfg), cfg).collect():
        near = [(abs(x.price_change), -x.start_ms, -x.direction) for x in found
                if x.market_id == r.market_id and x.outcome_index == r.outcome_index and r.timestamp_ms <= x.start_ms <= r.timestamp_ms + look * 60_000]
        assert r.jump_direction == (-max(near)[2] if near else None)


def test_edges_are_summed_where_their_pairs_are_made(make_tape):
    cfg = make_config(clustering={"bucket_size": 100, "size_normalizer": 1000.0})
    rng = random.Random(5)
    tape = make_tape([(rng.randrange(400) * 1000, f"w{rng.randrange(30):02d}", rng.randrange(2), rng.choice(["BUY", "SELL"]), 0.5,
                       float(rng.randrange(1, 4000)), rng.randrange(2)) for _ in range(500)])
    sizes = {}
    for r in tape.collect():
        cell = (r.market_id, r.timestamp_ms // 100_000, r.outcome_index, r.side)
        sizes.setdefault(cell, {}).setdefault(r.wallet, []).append(r.notional_usdc)
    want, total = {}, {}
    for (market, *_), held in sizes.items():
        for a, b in itertools.combinations(sorted(held), 2):
            weight = min((sum(held[a]) * sum(held[b])) ** 0.5 / 1000.0, cfg["clustering"]["max_size_mult"])
            want[market, a, b] = want.get((market, a, b), 0.0) + weight
            total[a, b] = total.get((a, b), 0.0) + weight
    cells = graph.bucket_sizes(tape, cfg)
    for block_pairs in (40, 1_000_000):
        edges = graph.edges_from_sizes(cells, cfg, ["market_id"], block_pairs=block_pairs)
        assert {(r.market_id, r.src, r.dst): r.weight for r in edges.collect()} == pytest.approx(want)
        merged = graph.merge_market_graphs(graph.edges_from_sizes(cells, cfg, ["market_id"], blocks=[], block_pairs=block_pairs))
        assert {(r.src, r.dst): r.weight for r in merged.collect()} == pytest.approx(total)
        for df in (edges, merged):  # no pair is moved
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not any("Exchange" in line and "src#" in line for line in plan.splitlines())


def test_metadata_needs_only_the_edges_inside_communities(spark, make_tape):
    cfg = make_config(clustering={"bucket_size": 100, "size_normalizer": 1000.0})
    rng = random.Random(6)
    tape = make_tape([(rng.randrange(300) * 1000, f"w{rng.randrange(20):02d}", 0, "BUY", 0.5, 2000.0, rng.randrange(2)) for _ in range(200)])
    member = tape.select("market_id", F.col("wallet").alias("node"), F.substring("wallet", 3, 1).alias("community")).distinct()
    inside = graph.bucket_graph(tape, cfg, within=member)
    assert inside.where(F.substring("src", 3, 1) != F.substring("dst", 3, 1)).isEmpty()
    key = lambda df: sorted((r.market_id, r.community, r.size, r.n_edges, round(r.total_edge_weight, 6), round(r.density, 6)) for r in df.collect())
    assert key(graph.cluster_metadata(inside, member)) == key(graph.cluster_metadata(graph.bucket_graph(tape, cfg), member))


def test_communities_of_a_task_equal_those_of_tables(spark):
    nodes = spark.createDataFrame([(f"w{i}",) for i in range(20)], "n string").select(F.xxhash64("n").alias("a"), F.xxhash64("n", F.lit(101)).alias("b")).toPandas()
    assert (graph.drawn(nodes.a.to_numpy(), 101) == nodes.b.to_numpy()).all()
    rng = random.Random(3)
    rows = [(m, *sorted(rng.sample([f"w{i:02d}" for i in range(n)], 2)), rng.random() * 3) for m, n, e in ((1, 14, 40), (2, 12, 14)) for _ in range(e)]
    edges = spark.createDataFrame(rows, "market_id int, src string, dst string, weight double")
    got = {(r.market_id, r.node): r.community for r in graph.communities(edges).collect()}
    assert got == {(r.market_id, r.node): r.community for r in graph.communities(edges, task_edges=20).collect()}
    assert len(got) > len({(m, c) for (m, _), c in got.items()}) > 2


def test_rounds_of_a_task_do_not_depend_on_its_table_of_links(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 200, (2, 4000))
    src, dst, seed = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], rng.integers(-2**62, 2**62, 200)
    weight = rng.random(len(src)) * 3
    got = graph.local_moves(src, dst, weight, seed)
    monkeypatch.setattr(graph, "LINK_CELLS", 0)
    assert (got == graph.local_moves(src, dst, weight, seed)).all()


def test_transfers_meet_their_graphs_as_one_row_a_pair(spark):
    rng = random.Random(8)
    member = [(m, f"W{i}", rng.choice("xy")) for m in range(6) for i in range(8) if rng.random() < 0.8] + [(0, "w1", "x"), (0, "W1", "x"), (1, None, "x")]
    moved = [("t", rng.randrange(9), f"w{rng.randrange(9)}", f"w{rng.randrange(9)}", float(rng.randrange(50))) for _ in range(120)]
    want = []
    for src, dst in {(r[2], r[3]) for r in moved if r[2] != r[3]}:
        own = [r[4] for r in moved if (r[2], r[3]) == (src, dst)]
        for a, b in itertools.product(member, member):
            if a[1] and b[1] and (a[1].lower(), b[1].lower()) == (src, dst) and (a[0], a[2]) == (b[0], b[2]):
                want.append((a[0], a[2], src, dst, sum(own), len(own)))
    df = spark.createDataFrame(moved, "tx_hash string, timestamp_s long, from_address string, to_address string, value_usdc double")
    links = graph.intra_cluster_transfers(df, spark.createDataFrame(member, "market_id int, node string, community string"))
    assert sorted(tuple(r) for r in links.collect()) == sorted(want)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan


def test_sizes_of_many_ticks_stay_off_the_driver(spark):
    """Sizes spread over ticks are small files and many rows: no join of them may be a broadcast; who can reach the weight stays."""
    cfg = make_config(clustering={"size_normalizer": 1.0, "max_size_mult": 5.0})
    rows = [(1, t, 0, 0, "BUY", w, s) for t in range(1, 40) for w, s in (("a", 4.0), ("b", 1.0), ("c", 0.01))]
    sizes = spark.createDataFrame(rows, "market_id int, tick long, bucket long, outcome_index int, side string, wallet string, size double")
    out = graph.prune_wallets(cut(sizes), cfg, 2.0, ["market_id", "tick"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.tick, r.wallet) for r in out.collect()} == {(t, w) for t in range(1, 40) for w in "ab"}
    member = spark.createDataFrame([(1, t, w, "a") for t in range(1, 40) for w in "ab"], "market_id int, tick long, node string, community string")
    meta = spark.createDataFrame([(1, t, "a", 2, 1.0, False, 1.5) for t in range(1, 40)],
                                 "market_id int, tick long, community string, size long, density double, has_common_ownership boolean, boost double")
    boosts = graph.wallet_boosts(cut(member), cut(meta), ["market_id", "tick"])
    assert "Broadcast" not in boosts._jdf.queryExecution().executedPlan().toString() and boosts.count() == 78
