"""Small cases with known answers, and brute-force checks on tapes with time ties."""

import random

import pytest
from pyspark.sql import functions as F

from tapescope.config import make_config
from tapescope.functions import stats
from tapescope.operators import causal, detectors, graph, jumps, labels, scoring, state
from tapescope.operators.iterate import greedy_starts
from tapescope.operators.quantiles import exact_quantiles
from tapescope.operators.running import Track, running

MIN = 60_000


def random_rows(n, seed, wallets=6, markets=2, hot=0.5):
    """Random trades; half of all rows fall on one market and one wallet."""
    rnd = random.Random(seed)
    ts = sorted(rnd.randrange(0, n * 40) * 1000 for _ in range(n))  # many equal times
    return [(t, "w0" if rnd.random() < hot else f"w{rnd.randrange(wallets)}", rnd.randrange(2), rnd.choice(["BUY", "SELL"]),
             rnd.randrange(1, 100) / 100, rnd.randrange(100, 9000), 1 if rnd.random() < hot else rnd.randrange(markets)) for t in ts]


@pytest.mark.parametrize("chunk", [1_000, 60_000, 10**9])
def test_running_matches_a_loop_for_any_chunk(make_tape, chunk):
    rows = random_rows(200, 1)
    df = running(make_tape(rows), ["market_id"], state.ORDER, [
        Track("s", "sum", F.col("notional_usdc")), Track("p", "last", F.when(F.col("side") == "BUY", F.col("price")))], chunk)
    got = {r.seq: (r.s, r.p) for r in df.collect()}
    sums, last = {}, {}
    for i, r in enumerate(rows):
        m = r[6]
        assert got[i] == (sums.get(m, 0.0), last.get(m))
        sums[m] = sums.get(m, 0.0) + r[5]
        if r[3] == "BUY":
            last[m] = r[4]


@pytest.mark.parametrize("hours", [1, 24])
def test_baseline_window_ends_at_previous_trade(make_tape, hours):
    rows = random_rows(150, 2)
    t = make_tape(rows)
    got = {r.seq: (r.base_n, r.base_mean) for r in state.rolling_stats(state.market_state(t, chunk_ms=50_000), t, hours * 3_600_000, 50_000).collect()}
    seen = {}
    for i, r in enumerate(rows):
        live = seen.setdefault(r[6], [])
        n, mean = got[i]
        assert n == len(live)
        if live:
            assert mean == pytest.approx(sum(x for _, x in live) / len(live))
        live.append((r[0], r[5]))
        live[:] = [x for x in live if x[0] >= r[0] - hours * 3_600_000]


def test_gap_medians_match_a_ring(make_tape):
    rows = random_rows(300, 3, markets=1, hot=1.0)
    got = {r.seq: (r.gap_median, r.gap_n) for r in state.gap_medians(make_tape(rows), 40_000, block_rows=250).collect()}
    last, ring, want = {}, {}, {}
    for i, r in enumerate(rows):
        o = r[2]
        if o in last and r[0] > last[o]:
            ring.setdefault(o, []).append(r[0] - last[o])
            s = sorted(ring[o][-200:])
            k = len(s)
            want[i] = ((s[(k - 1) // 2] + s[k // 2]) / 2, k)
        last[o] = r[0]
    assert got == want


def test_recidivism_replay_matches_a_loop(spark, make_tape):
    cfg = make_config(recidivism={"min_prior_flags": 1, "midpoint": 2.0, "k": 0.9, "max_confidence": 0.6})
    rows = random_rows(200, 4, wallets=3)
    rnd = random.Random(9)
    base = [rnd.choice([0.0, 0.1, 0.2, 0.3, 0.45, 0.6]) for _ in rows]
    b = spark.createDataFrame(list(enumerate(base)), "seq long, base_score double")
    df = scoring.recidivism_replay(make_tape(rows).join(b, "seq"), cfg)
    got = {r.seq: (round(r.total_score, 9), r.is_alert) for r in df.collect()}
    flags = {}
    for i, r in enumerate(rows):
        k = (r[6], r[1])
        n = flags.get(k, 0)
        c = scoring._sigmoid(cfg["recidivism"], n) if n >= 1 else 0.0
        s = 1 - (1 - base[i]) * (1 - c)
        assert got[i] == (round(s, 9), s >= 0.5)
        flags[k] = n + (s >= 0.5)


def test_greedy_batches(make_tape):
    t = make_tape([(x, "a", 0, "BUY", 0.5, 10) for x in (0, 1000, 5000, 9000, 12000)])
    got = [(r.start_ms, r.n) for r in causal.event_time_batches(t, 5.0).orderBy("batch_no").collect()]
    assert got == [(0, 2), (5000, 2), (12000, 1)]


def test_greedy_starts_match_a_loop(spark):
    rnd = random.Random(5)
    times = sorted(rnd.sample(range(3000), 250))
    got = sorted(r.t for r in greedy_starts(spark.createDataFrame([(1, t) for t in times], "k int, t long"), ["k"], "t", 37, 500).collect())
    want, nxt = [], -1
    for t in times:
        if t >= nxt:
            want.append(t)
            nxt = t + 37
    assert got == want


def test_recluster_tick(make_tape):
    cfg = make_config(clustering={"min_cluster_interval": 300, "max_cluster_interval": 3600, "significant_change_threshold": 2})
    t = make_tape([(s * 1000, f"w{s}", 0, "BUY", 0.5, 6000) for s in (0, 60, 120, 360)])
    assert [r.seq for r in causal.recluster_ticks(t, cfg).collect()] == [3]


def test_bucket_graph_weights(make_tape):
    cfg = make_config(clustering={"size_normalizer": 1000.0, "max_size_mult": 10.0})
    t = make_tape([(0, "a", 0, "BUY", 0.5, 1000), (1000, "a", 0, "BUY", 0.5, 3000), (2000, "b", 0, "BUY", 0.5, 4000)])
    assert [(r.src, r.dst, r.weight) for r in graph.bucket_graph(t, cfg).collect()] == [("a", "b", 4.0)]
    apart = make_tape([(0, "a", 0, "BUY", 0.5, 1000), (1, "b", 0, "SELL", 0.5, 1000), (2, "c", 1, "BUY", 0.5, 1000)])
    assert graph.bucket_graph(apart, cfg).count() == 0


def test_pairs_of_a_split_bucket_are_complete(spark):
    rows = spark.createDataFrame([(1, f"w{i:03d}", float(i)) for i in range(60)], "k int, wallet string, size double")
    cells = graph.pair_cells(rows, ["k"], block=16)
    assert cells.select("_pair").distinct().count() > 1
    keep, graph.PAIR_BLOCK = graph.PAIR_BLOCK, 16
    try:
        graph.pair_cells.__defaults__ = ("wallet", 16)
        assert graph.member_pairs(rows, ["k"], ["size"]).count() == 60 * 59 // 2
    finally:
        graph.PAIR_BLOCK = keep
        graph.pair_cells.__defaults__ = ("wallet", keep)


def test_core_and_communities(spark):
    tri = [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("a", "d", 0.1)]
    edges = spark.createDataFrame([(1, *e) for e in tri], "market_id int, src string, dst string, weight double")
    core = graph.k_core(graph.filter_edges(edges, 0.5), 2)
    member = graph.communities(core)
    assert sorted((r.node, r.community) for r in member.collect()) == [("a", "a"), ("b", "a"), ("c", "a")]
    meta = graph.cluster_metadata(core, member).collect()[0]
    assert (meta["size"], meta["density"], meta["total_edge_weight"]) == (3, 1.0, 3.0)


def test_communities_split_two_cliques(spark):
    def clique(names, w):
        return [(a, b, w) for i, a in enumerate(names) for b in names[i + 1:]]
    e = clique("abcd", 2.0) + clique("wxyz", 2.0) + [("a", "w", 0.1)]
    edges = spark.createDataFrame([(1, *x) for x in e], "market_id int, src string, dst string, weight double")
    got = {r.node: r.community for r in graph.communities(edges).collect()}
    assert len({got[n] for n in "abcd"}) == 1 and len({got[n] for n in "wxyz"}) == 1 and got["a"] != got["w"]


def test_cluster_boost_and_coordination(spark):
    cfg = make_config(cluster_boost={"size_normalizer": 10.0, "size_weight": 0.4, "density_weight": 0.2, "ownership_boost": 0.4})
    row = spark.createDataFrame([(3, 0.5, True)], "size int, density double, has_common_ownership boolean")
    assert row.select(graph.cluster_boost(cfg)).first()[0] == pytest.approx(1.8)
    c = spark.createDataFrame([("x", 5, 0.9, True)], "cluster_id string, cluster_size int, cluster_density double, has_common_ownership boolean")
    assert c.select(detectors.cluster_coordination(cfg)).first()[0] == pytest.approx(0.85)


def test_jumps_and_scores(make_tape):
    cfg = make_config(jumps={"jump_threshold": 0.05, "jump_window_minutes": 30})
    t = make_tape([(0, "a", 0, "BUY", 0.40, 1), (10 * MIN, "a", 0, "BUY", 0.46, 1), (0, "a", 1, "BUY", 0.70, 1), (5 * MIN, "a", 1, "BUY", 0.62, 1)])
    assert sorted((r.outcome_index, r.direction) for r in jumps.find_jumps(t, cfg).collect()) == [(0, 1), (1, -1)]


def test_largest_coming_jump_decides(spark, make_tape):
    cfg = make_config(jumps={"pre_jump_lookback_minutes": 60, "min_pre_jump_trades": 1})
    t = make_tape([(0, "a", 0, "SELL", 0.5, 1), (0, "b", 0, "BUY", 0.5, 1), (0, "c", 1, "BUY", 0.5, 1)])
    j = spark.createDataFrame([(1, 0, 10 * MIN, 12 * MIN, 0.05, 1), (1, 0, 20 * MIN, 22 * MIN, -0.20, -1)],
                              "market_id int, outcome_index int, start_ms long, end_ms long, price_change double, direction int")
    got = {r.wallet: r.jump_boost for r in jumps.score_jump_wallets(t, j, cfg).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": 1.0}


def test_detector_cases(make_tape):
    cfg = make_config(volume_anomaly={"min_trades_for_baseline": 5, "min_absolute_notional": 100.0})
    t = make_tape([(i * MIN, f"w{i}", 0, "BUY", 0.5, n) for i, n in enumerate((100, 120, 80, 100, 110, 500))])
    df = detectors.detect(detectors.with_state(t, cfg), cfg)
    last = df.where("seq = 5").first()
    assert last.base_n == 5 and last.conf_volume_anomaly > 0
    t = make_tape([(0, "a", 0, "BUY", 0.5, 6000), (MIN, "a", 0, "BUY", 0.5, 10)])
    last = detectors.detect(detectors.with_state(t, cfg), cfg).where("seq = 1").first()
    assert last.outcome_exposure == 6000 and last.outcome_concentration == 1.0 and last.conf_accumulation == pytest.approx(0.8)
    rows = [(m * MIN, "a", 0, "BUY", 0.5, 2000) for m in (0, 5, 10, 15, 20)] + [(40 * MIN, "b", 1, "BUY", 0.5, 2000)]
    c = make_config(contra_silence={"min_gap_samples": 3, "silence_threshold": 3.0})
    last = detectors.with_state(make_tape(rows), c).where("seq = 5").select(detectors.silence_ratio()).first()
    assert last[0] == 4.0


def test_labels(make_tape):
    rows = [(0, "alpha", 0, "BUY", 0.20, 200), (1, "alpha", 0, "BUY", 0.50, 100), (2, "beta", 1, "BUY", 0.50, 100), (3, "gamma", 0, "BUY", 0.50, 100)]
    t = make_tape(rows)
    w = t.sparkSession.createDataFrame([(1, 0)], "market_id int, winner int")
    got = {r.wallet: (round(r.wallet_return, 9), round(r.net_pnl, 6), r.is_insider)
           for r in labels.label(labels.wallet_pnl(t, w, 50.0), z_threshold=0.9).collect()}
    assert got == {"alpha": (3.0, 900.0, True), "beta": (-1.0, -100.0, False), "gamma": (1.0, 100.0, False)}


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    import numpy as np

    from tapescope.operators import quantiles
    monkeypatch.setattr(quantiles, "SMALL", 100)
    monkeypatch.setattr(quantiles, "ACCURACY", 2000)
    rnd = random.Random(6)
    v = [rnd.choice([rnd.gauss(0, 1), 1.0, rnd.expovariate(0.1)]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = {r.prob: r["quantile"] for r in exact_quantiles(df, [], {"x": F.col("x")}, (0.05, 0.5, 0.95)).collect()}
    for p, q in got.items():
        assert q == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def test_p_values():
    assert stats.student_two_sided([2.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-7)
    # closed forms: 1 - 2/pi * atan(t) for one degree of freedom, 1 - t/sqrt(2 + t^2) for two
    assert stats.student_two_sided([1.0], [1.0])[0] == pytest.approx(0.5, abs=1e-10)
    assert stats.student_two_sided([0.5], [2.0])[0] == pytest.approx(1 - 0.5 / 1.5, abs=1e-10)
    assert stats.normal_sf([1.959964])[0] == pytest.approx(0.025, abs=1e-6)


def test_replay_plan_has_no_global_window(make_tape):
    plan = scoring.replay(make_tape(random_rows(20, 7)), make_config())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Exchange SinglePartition" not in plan


def test_classifier_entries(spark):
    from tapescope.sources.readers import normalize_classifications
    rows = [(1, " election ", 1.7, None), (2, "Weather", 0.1, None), (3, "politics", 0.9, None), (4, None, 0.9, None), (5, "LEGAL", 0.9, "failed"), (6, "legal", None, None)]
    got = {r["id"]: (r["category"], r["confidence"], r["status"], r["insider_plausible"])
           for r in normalize_classifications(spark.createDataFrame(rows, "id int, category string, confidence double, status string")).collect()}
    failed = (None, 0.0, "failed", False)
    assert got == {1: ("ELECTION", 1.0, "success", True), 2: ("WEATHER", 0.1, "success", False), 3: failed, 4: failed, 5: failed, 6: ("LEGAL", 0.0, "success", True)}


def test_trade_records_with_text_numbers_and_hex_ids(spark):
    from tapescope.sources.readers import parse_trade_json
    from tapescope.streaming.feeds import as_tape
    rows = ['{"proxyWallet":"0xa","conditionId":"0xff01","side":"BUY","size":"10","price":"0.5","timestamp":"1700000000","outcomeIndex":"1","transactionHash":"0x12ab","asset":"7"}',
            '{"proxyWallet":"0xa","conditionId":"12","side":"BUY","size":10,"price":0.5,"timestamp":1700000000,"outcomeIndex":1,"transactionHash":"tx34","asset":"7"}',
            '{"proxyWallet":"0xa","conditionId":"12","size":"many","price":0.5,"timestamp":1}', "{broken"]
    got = as_tape(parse_trade_json(spark.createDataFrame([(r,) for r in rows], "value string"))).collect()
    assert len(got) == 2 and all((r["notional_usdc"], r["timestamp_ms"], r["outcome_index"]) == (5.0, 1_700_000_000_000, 1) for r in got)
    by = {r["condition_id"]: r for r in got}
    assert by["12"]["market_id"] == 12 and by["12"]["seq"] == 34 and by["0xff01"]["market_id"] is not None


def test_markets_without_tokens_are_dropped(spark):
    from tapescope.sources.readers import parse_market_json
    rows = [(1, '["a","b"]', "q"), (2, "[]", "q"), (3, "", "q"), (4, None, "q"), (5, "a, b", "q")]
    df = spark.createDataFrame(rows, "id int, token_ids string, question string").selectExpr("*", "'[]' AS outcomes", "CAST(NULL AS STRING) AS event_title")
    assert sorted(r["id"] for r in parse_market_json(df).collect()) == [1, 5]


def test_student_p_values_of_large_samples():
    import numpy as np
    from tapescope.functions.stats import student_two_sided
    got = student_two_sided(np.array([0.01, 2.0, 0.5]), np.array([1e10, 1e10, 1.0]))
    assert np.allclose(got, [0.99202128, 0.04550026, 0.70483276], atol=1e-7)
