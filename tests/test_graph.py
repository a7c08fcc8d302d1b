"""Edges that stay packed, and the sums of a community search, against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapescope.config import make_config
from tapescope.operators import graph


def random_tape(make_tape, seed, n=300, wallets=24):
    rng = random.Random(seed)
    return make_tape([(rng.randrange(400) * 1000, f"w{rng.randrange(wallets):02d}", rng.randrange(2), rng.choice(["BUY", "SELL"]), 0.5,
                       float(rng.randrange(4000)), rng.randrange(2)) for _ in range(n)])


def test_packed_edges_are_counted_where_they_are(make_tape):
    cfg = make_config(clustering={"bucket_size": 100, "size_normalizer": 1000.0})
    cells = graph.bucket_sizes(random_tape(make_tape, 4), cfg)
    for block_pairs in (30, 1_000_000):
        plain = graph.edges_from_sizes(cells, cfg, ["market_id"], block_pairs=block_pairs)
        packed = graph.edges_from_sizes(cells, cfg, ["market_id"], block_pairs=block_pairs, packed=True)
        assert packed.columns == ["market_id", "_edges"]
        for keys in (["market_id"], []):
            want = {tuple(r[k] for k in keys): (r.n_edges, r.total_edge_weight) for r in graph.totals(plain, keys).collect()}
            got = {tuple(r[k] for k in keys): (r.n_edges, r.total_edge_weight) for r in graph.totals(packed, keys).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    none = graph.totals(graph.edges_from_sizes(cells.limit(0), cfg, ["market_id"], packed=True), []).first()
    assert (none.n_edges, none.total_edge_weight) == (0, None)


def test_unknown_sizes_weigh_as_much_as_can_be(spark):
    cfg = make_config(clustering={"size_normalizer": 1000.0, "max_size_mult": 5.0})
    rows = [(1, 0, 0, "BUY", "a", None), (1, 0, 0, "BUY", "b", 1000.0), (1, 0, 0, "BUY", "c", 4000.0), (1, 0, 0, "BUY", None, 9.0), (1, None, 0, "BUY", "a", 9.0), (1, None, 0, "BUY", "b", 9.0)]
    sizes = spark.createDataFrame(rows, "market_id int, bucket long, outcome_index int, side string, wallet string, size double")
    got = {(r.src, r.dst): r.weight for r in graph.edges_from_sizes(sizes, cfg, ["market_id"]).collect()}
    assert got == {("a", "b"): 5.0, ("a", "c"): 5.0, ("b", "c"): 2.0}


def test_blocks_hold_whole_pairs():
    rng = np.random.default_rng(2)
    cell, wallet = rng.integers(0, 12, 90), rng.integers(0, 15, 90)
    first = np.unique(cell * 15 + wallet, return_index=True)[1]
    cell, wallet = cell[first], wallet[first]
    size, market, group = rng.random(len(cell)), cell % 2, wallet % 3
    want = {}
    for p, q in itertools.combinations(range(len(cell)), 2):
        if cell[p] == cell[q]:
            key = (market[p], *sorted((wallet[p], wallet[q])))
            want[key] = want.get(key, 0.0) + min((size[p] * size[q]) ** 0.5, 0.6)
    for block in (1, 7, 1000):
        got = {}
        for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
            own = (group == i) | (group == j)
            for g, a, b, w in graph.pair_sums(cell[own], market[own], wallet[own], size[own], (group[own], i, j), 1.0, 0.6, block):
                for key, weight in zip(zip(g, a, b), w):
                    assert key not in got
                    got[key] = weight
        assert got == pytest.approx(want)


def test_sums_in_place_equal_sums_by_order(monkeypatch):
    rng = np.random.default_rng(7)
    s, d, w = np.sort(rng.integers(0, 30, 500)), rng.integers(0, 20, 500), rng.random(500)
    in_place = graph.summed(s, d, w, 20)
    monkeypatch.setattr(graph, "DENSE_CELLS", 0)
    for a, b in zip(in_place, graph.summed(s, d, w, 20)):
        assert (a == b).all()
    assert [len(x) for x in graph.summed(s[:0], d[:0], w[:0], 20)] == [0, 0, 0]
