"""Wallet co-activity graphs: edges, cores, communities, ownership, boosts.

Every function is keyed: ``keys`` names the columns that tell graphs apart (by
default one graph per market), so many graphs share each job.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.session import cut

#: Members of a cell that meet those of the same or another such group in one join key.
PAIR_BLOCK = 4096

#: The same for trades of a time slot, of whose pairs most are too far apart.
BAND_BLOCK = 256

#: Pairs of wallets that a task makes at a time, about, how many times that it may make in all, and the sizes it may hold.
BLOCK_PAIRS, TASK_BLOCKS, TASK_SIZES = 2_000_000, 20, 2_000_000


def large_trades(tape: DataFrame, cfg: dict) -> DataFrame:
    return tape.where(F.col("notional_usdc") >= cfg["clustering"]["min_trade_size"])


def bucket_sizes(trades: DataFrame, cfg: dict, keys: list[str] = ["market_id"]) -> DataFrame:
    """Notional per wallet in each directional time bucket."""
    c = cfg["clustering"]
    bucket = F.floor(F.floor(F.col("timestamp_ms") / 1000) / c["bucket_size"])
    return (trades.groupBy(*keys, bucket.alias("bucket"), "outcome_index", "side", "wallet")
            .agg(F.sum("notional_usdc").alias("size")))


def prune_wallets(sizes: DataFrame, cfg: dict, min_weight: float, keys: list[str] = ["market_id"]) -> DataFrame:
    """Drop wallets that cannot reach ``min_weight`` with any partner (exact).

    In each bucket the best a wallet can do is to meet the largest participant.
    Cells and wallets of all graphs are as many as ``sizes`` may hold, so they meet by sort and merge: sizes that were spread
    over ticks compress to a few MB of file, which the planner would send whole to the driver.
    """
    c, cell = cfg["clustering"], [*keys, "bucket", "outcome_index", "side"]
    top = sizes.groupBy(*cell).agg(F.max("size").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").hint("merge")
    bound = F.least(F.sqrt(F.col("size") * F.col("_top")) / c["size_normalizer"], F.lit(c["max_size_mult"]))
    able = (sizes.join(top, cell).groupBy(*keys, "wallet").agg(F.sum(bound).alias("_bound"))
            .where(F.col("_bound") >= min_weight * (1 - 1e-9)))
    return sizes.join(able.select(*keys, "wallet").hint("merge"), [*keys, "wallet"], "left_semi")


def group_pairs(rows: DataFrame, groups: Column) -> DataFrame:
    """Each row once for every pair (i <= j) of its own group ``_g`` and one of all ``groups``, as ``_pair``."""
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), groups - 1), lambda j: F.struct(
        F.least(F.col("_g"), j).alias("i"), F.greatest(F.col("_g"), j).alias("j")))
    return rows.withColumn("_pair", F.explode(pairs))


def pair_cells(rows: DataFrame, cell: list[str], member: str = "wallet", block: int = PAIR_BLOCK) -> DataFrame:
    """Split cells with many members so that no task pairs up a whole cell.

    Members of a cell of n get one of g = ceil(n / block) groups; a group pair
    (i, j) becomes its own join key.  Adds ``_g`` (own group) and ``_pair``.
    """
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    g = F.ceil(F.col("_n") / block)
    tagged = rows.join(counts, cell).withColumn("_g", F.pmod(F.xxhash64(member), g))
    return group_pairs(tagged, g).drop("_n")


def member_pairs(rows: DataFrame, cell: list[str], carry: list[str], member: str = "wallet") -> DataFrame:
    """Unordered member pairs of each cell (``src < dst``), each exactly once."""
    cells = pair_cells(rows.select(*cell, member, *carry), cell, member)
    # a group stands on the first side of its pairs with later groups, on the second of those with earlier ones
    one = cells.where("_pair.i = _g").select(*cell, "_pair", F.col(member).alias("_one"), *[F.col(c).alias(f"_one_{c}") for c in carry])
    two = cells.where("_pair.j = _g").select(*cell, "_pair", F.col(member).alias("_two"), *[F.col(c).alias(f"_two_{c}") for c in carry])
    ahead = F.col("_one") < F.col("_two")
    met = one.join(two, [*cell, "_pair"]).where(ahead | ((F.col("_pair.i") < F.col("_pair.j")) & (F.col("_one") > F.col("_two"))))
    turned = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return met.select(*cell, turned("_one", "_two").alias("src"), turned("_two", "_one").alias("dst"),
                      *[turned(f"_one_{c}", f"_two_{c}").alias(f"{c}_a") for c in carry], *[turned(f"_two_{c}", f"_one_{c}").alias(f"{c}_b") for c in carry])


def pair_weight(cfg: dict) -> Column:
    c = cfg["clustering"]
    return F.least(F.sqrt(F.col("size_a") * F.col("size_b")) / c["size_normalizer"], F.lit(c["max_size_mult"]))


def bucket_graph(trades: DataFrame, cfg: dict, keys: list[str] = ["market_id"], min_weight: float | None = None,
                 within: DataFrame | None = None, blocks: list[str] | None = None, packed: bool = False) -> DataFrame:
    """Edges between wallets that made the same bet in the same time bucket.

    ``within`` (keys, node, community) asks only for the edges inside
    communities; the edges then say in which.  ``blocks``, ``packed``: see :func:`edges_from_sizes`.
    """
    return edges_from_sizes(bucket_sizes(trades, cfg, keys), cfg, keys, min_weight, within, blocks, packed=packed)


def edges_from_sizes(sizes: DataFrame, cfg: dict, keys: list[str], min_weight: float | None = None, within: DataFrame | None = None,
                     blocks: list[str] | None = None, block_pairs: int = BLOCK_PAIRS, packed: bool = False) -> DataFrame:
    """Edges of the graphs told apart by ``keys``, their weights summed where the pairs are made.

    The wallets of a graph are dealt into groups.  All that two groups have in common meets in one
    task, so what is moved are the sizes, once for each group, and never a pair; the task makes and sums
    about ``block_pairs`` pairs at a time.
    ``blocks`` names the keys that wallets are dealt by, if not all of ``keys``: the edges then
    stay packed, a row for each step of a task, and can be merged in place.  ``packed`` edges can be counted in place.
    """
    if min_weight is not None:
        sizes = prune_wallets(sizes, cfg, min_weight, keys)
    if within is not None:
        sizes = sizes.join(within.select(*keys, F.col("node").alias("wallet"), "community"), [*keys, "wallet"])
        keys = [*keys, "community"]
    at, cell = [*(keys if blocks is None else blocks)], [*keys, "bucket", "outcome_index", "side"]
    packed = packed or blocks is not None
    sizes = cut(sizes.select(*cell, "wallet", "size"))
    shared = sizes.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    load = cut(shared.groupBy(*at).agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_pairs"), F.sum("_n").alias("_entries")).where("_pairs > 0"))
    pairs = load.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0))).first()[0]
    cores = sizes.sparkSession.sparkContext.defaultParallelism
    of_task = min(max(block_pairs, pairs / (2 * cores)), TASK_BLOCKS * block_pairs)
    groups = load.select(*at, F.greatest(F.ceil(F.sqrt(2 * F.col("_pairs") / of_task)), F.ceil(2 * F.col("_entries") / TASK_SIZES)).alias("_groups"))
    sizes = sizes.join(shared.select(*cell).hint("merge"), cell, "left_semi").where("wallet is not null")
    sizes = sizes.join(groups, at) if at else sizes.crossJoin(groups)
    sizes = group_pairs(sizes.withColumn("_g", F.pmod(F.xxhash64("wallet"), F.col("_groups"))), F.col("_groups"))
    met = sizes.select(*cell, "wallet", F.col("size").cast("double").alias("size"), "_g", F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"))
    c, graph = cfg["clustering"], [k for k in keys if k not in at]
    rest = [x for x in cell if x not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    columns = [f"{k} {kinds[k]}" for k in (at if packed else keys)] + (["_edges binary"] if packed else ["src string", "dst string", "weight double"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        first = {k: rows[k][0] for k in at}
        names, wallet = coded(rows["wallet"])
        kinds, number = _numbered(rows, graph)
        sides = rows["_g"].to_numpy(), int(rows["_i"][0].as_py()), int(rows["_j"][0].as_py())
        for g, a, b, weight in pair_sums(_numbered(rows, rest, number)[1], number, wallet, rows["size"].to_numpy(), sides, c["size_normalizer"], c["max_size_mult"], block_pairs):
            if packed:
                held = Packed({k: kinds[k].take(pa.array(g)) for k in graph}, *used(names, a, b), weight)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(first[k], 1) for k in at), pa.array([pickle.dumps(held)], pa.binary())], names=[*at, "_edges"])
            else:
                yield pa.RecordBatch.from_arrays([*(pa.repeat(first[k], len(a)) for k in at), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(weight)],
                                                 names=[*at, "src", "dst", "weight"])

    met = met.repartition(max(cores, int(2 * pairs / of_task)), *at, "_i", "_j")
    edges = met.groupBy(*at, "_i", "_j").applyInArrow(made, ", ".join(columns))
    return edges if min_weight is None or packed else filter_edges(edges, min_weight)


@dataclass
class Packed:
    """Edges that one step of a task has made: their graphs, the names of their wallets, the ends as places in ``names``, and the weights."""

    graph: dict[str, pa.Array]
    names: pa.Array
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray


def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(distinct values in order, the place of each row's value in them)."""
    held = column.combine_chunks().dictionary_encode()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    order = pc.array_sort_indices(held.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return held.dictionary.take(pa.array(order)), rank[held.indices.to_numpy()]


def _numbered(rows: pa.Table, columns: list[str], number: np.ndarray | None = None) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(the values of ``columns`` by number, the number of each row); rows with the same values (and ``number``) share one."""
    number = np.zeros(rows.num_rows, np.int64) if number is None else number
    for c in columns:
        _, place = coded(rows[c])
        number = np.unique(number * (place.max(initial=0) + 1) + place, return_inverse=True)[1]
    first = np.zeros(number.max(initial=-1) + 1, np.int64)
    first[number[::-1]] = np.arange(rows.num_rows)[::-1]
    return {c: rows[c].combine_chunks().take(pa.array(first)) for c in columns}, number


def used(names: pa.Array, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Only the names that stand in ``a`` and ``b``, and the places in them."""
    held = np.zeros(len(names), bool)
    held[a] = held[b] = True
    place = (np.cumsum(held) - 1).astype(np.int32)
    return names.take(pa.array(np.flatnonzero(held))), place[a], place[b]


def pair_sums(cell: np.ndarray, graph: np.ndarray, wallet: np.ndarray, size: np.ndarray, sides: tuple[np.ndarray, int, int], normalizer: float, most: float,
              block_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(graph, smaller wallet, larger wallet, weight) of all pairs of members of the groups ``sides`` that share cells, about ``block_pairs`` pairs at a time.

    Each pair stands in one block only, with all its cells.
    """
    group, i, j = sides
    order = np.lexsort((wallet, cell))
    two = order[group[order] == j]
    at, members = cell[two], wallet[two]
    one = two if i == j else order[group[order] == i]
    # members of the second side in the cell of each row of the first; inside a group those behind it
    low = np.arange(1, len(two) + 1) if i == j else np.searchsorted(at, cell[one])
    high = np.searchsorted(at, cell[one], "right")
    by_wallet = np.argsort(wallet[one], kind="stable")
    one, low, number = one[by_wallet], low[by_wallet], (high - low)[by_wallet]
    total = np.cumsum(number)
    ends = np.flatnonzero(np.append(wallet[one][1:] != wallet[one][:-1], True)) + 1 if len(one) else np.empty(0, np.int64)
    n, n_graphs, begin = int(wallet.max(initial=0)) + 1, int(graph.max(initial=0)) + 1, 0
    while begin < len(one):
        before = total[begin - 1] if begin else 0
        end = int(ends[max(np.searchsorted(ends, begin, "right"), np.searchsorted(total[ends - 1], before + block_pairs, "right") - 1)])
        some, count = one[begin:end], number[begin:end]
        begin = end
        made = int(count.sum())
        if not made:
            continue
        left = np.repeat(np.arange(len(some)), count)
        right = np.arange(made) + np.repeat(low[end - len(some):end] - (np.cumsum(count) - count), count)
        with np.errstate(invalid="ignore", over="ignore"):
            weight = np.fmin(np.sqrt(size[some][left] * size[two][right]) / normalizer, most)
        rows, row = np.unique(wallet[some] * n_graphs + graph[some], return_inverse=True)
        key = row[left] * n + members[right]
        if len(rows) * n <= 4 * made:
            there = np.flatnonzero(np.bincount(key, minlength=1))
            weight = np.bincount(key, weight)[there]
        else:
            there, place = np.unique(key, return_inverse=True)
            weight = np.bincount(place, weight, len(there))
        row, b = rows[there // n], there % n
        a, g = row // n_graphs, row % n_graphs
        yield g, np.minimum(a, b), np.maximum(a, b), weight


def theta_graph(trades: DataFrame, cfg: dict, keys: list[str] = ["market_id"], block: int = BAND_BLOCK) -> DataFrame:
    """Pairwise graph: every two trades within the time window add to the edge."""
    c = cfg["clustering"]
    w = c["max_time_window"]
    dt = F.abs(F.col("t_a") - F.col("t_b"))
    size = F.least(F.sqrt(F.col("notional_usdc_a") * F.col("notional_usdc_b")) / c["size_normalizer"], F.lit(c["max_size_mult"]))
    weight = ((1.0 - dt / w) * size
              * F.when(F.col("side_a") == F.col("side_b"), c["same_direction_mult"]).otherwise(1.0)
              * F.when(F.col("outcome_index_a") != F.col("outcome_index_b"), c["cross_outcome_penalty"]).otherwise(1.0))
    return (band_pairs(trades, w, keys, block).where(dt <= w)
            .groupBy(*keys, F.least("wallet_a", "wallet_b").alias("src"), F.greatest("wallet_a", "wallet_b").alias("dst"))
            .agg(F.sum(weight).alias("weight")).where("weight > 0"))


def band_pairs(trades: DataFrame, width_s: int, keys: list[str], block: int = BAND_BLOCK) -> DataFrame:
    """Pairs of trades of different wallets in the same or the next time slot, each once.

    Time is cut into slots as wide as the band, so a trade meets its own slot and
    the one before.  A busy slot is cut into groups of about ``block`` trades;
    every two groups that meet are a join key of their own, so a busy hour of
    one market is spread over as many tasks as it has pairs of groups.
    """
    cols = ["wallet", "side", "outcome_index", "notional_usdc", "t"]
    rows = trades.select(*keys, "seq", "wallet", "side", "outcome_index", "notional_usdc", F.floor(F.col("timestamp_ms") / 1000).alias("t")).withColumn(
        "slot", F.floor(F.col("t") / width_s))
    counts = cut(rows.groupBy(*keys, "slot").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_g")))
    rows = rows.join(counts, [*keys, "slot"]).withColumn("_own", F.pmod(F.xxhash64("seq"), F.col("_g"))).drop("_g")
    groups = lambda shift, name: counts.select(*keys, (F.col("slot") + shift).alias("cell"), F.col("_g").alias(name))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # in cell s stand the trades of s (b) and those of s and s + 1 (a)
    a = rows.select(*keys, "slot", F.col("_own").alias("_ga"), *[F.col(x).alias(f"{x}_a") for x in cols]).withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1))))
    a = a.withColumn("cell", F.col("slot") - F.col("_ahead")).join(groups(0, "_n"), [*keys, "cell"]).withColumn("_gb", F.explode(numbers("_n"))).drop("_n", "slot")
    b = rows.select(*keys, F.col("slot").alias("cell"), F.col("_own").alias("_gb"), *[F.col(x).alias(f"{x}_b") for x in cols])
    b = b.join(groups(0, "_n0"), [*keys, "cell"]).join(groups(-1, "_n1"), [*keys, "cell"], "left")
    there = F.concat(F.transform(numbers("_n0"), lambda g: F.struct(F.lit(0).alias("_ahead"), g.alias("_ga"))),
                     F.when(F.col("_n1").isNotNull(), F.transform(numbers("_n1"), lambda g: F.struct(F.lit(1).alias("_ahead"), g.alias("_ga")))).otherwise(
                         F.array().cast("array<struct<_ahead:int,_ga:bigint>>")))
    b = b.withColumn("_at", F.explode(there)).select(*keys, "cell", "_gb", "_at._ahead", "_at._ga", *[f"{x}_b" for x in cols])
    # same slot: each unordered pair once by wallet order; neighbouring slots: once by slot order
    once = F.when(F.col("_ahead") == 0, F.col("wallet_a") < F.col("wallet_b")).otherwise(F.col("wallet_a") != F.col("wallet_b"))
    return a.join(b, [*keys, "cell", "_ahead", "_ga", "_gb"]).where(once).drop("cell", "_ahead", "_ga", "_gb")


def merge_market_graphs(edges: DataFrame) -> DataFrame:
    """One graph over all markets: weights summed; packed edges are summed where they are."""
    if "_edges" not in edges.columns:
        return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column("_edges"):
                e = pickle.loads(held.as_py())
                key, place = np.unique(e.src.astype(np.int64) * len(e.names) + e.dst, return_inverse=True)
                yield pa.RecordBatch.from_arrays([e.names.take(pa.array(key // len(e.names))), e.names.take(pa.array(key % len(e.names))),
                                                  pa.array(np.bincount(place, e.weight, len(key)))], names=["src", "dst", "weight"])

    return edges.mapInArrow(merged, "src string, dst string, weight double")


def filter_edges(edges: DataFrame, min_weight: float) -> DataFrame:
    return edges.where(F.col("weight") >= min_weight)


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select(*keys, "src", "dst", "weight").unionByName(back)


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))


def connected(edges: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """(keys, node, component) of every node on an edge; the component is its smallest node.

    Alternating large-star and small-star rounds: the distance to the smallest
    node shrinks by a factor, so the rounds grow with its logarithm.
    """
    pairs = cut(edges.select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return pairs.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(*keys, "v", "v").distinct())
        seen = state
        ways = pairs.union(pairs.select(*keys, "v", "u"))
        least = ways.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(ways.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.union(least).distinct())


#: Edges of a component (and about those of a group of components) that one task peels.
CORE_EDGES = 500_000


def peeled(src: np.ndarray, dst: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which edges between the nodes 0 to n - 1 are in the k-core: nodes leave one by one, each edge is looked at twice."""
    ends = np.concatenate([src, dst])
    by_node = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[by_node], np.arange(n + 1))
    degree, alive = np.bincount(ends, minlength=n), np.ones(len(src), bool)
    left = list(np.flatnonzero(degree < k))
    gone = degree < k
    while left:
        node = left.pop()
        for e in by_node[first[node]:first[node + 1]] % len(src):
            if alive[e]:
                alive[e] = False
                other = dst[e] if src[e] == node else src[e]
                degree[other] -= 1
                if degree[other] < k and not gone[other]:
                    gone[other] = True
                    left.append(other)
    return alive


#: Layers that are peeled off a large graph before its components are looked for.
CORE_LAYERS = 3


def by_size(edges: DataFrame, keys: list[str], most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(edges of graphs of at most ``most`` edges, those of the larger graphs); None stands for no such graph."""
    if not keys:
        return (edges, None) if edges.count() <= most else (None, edges)
    large = cut(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys))
    if large.isEmpty():
        return edges, None
    return edges.join(large, keys, "left_anti"), edges.join(large, keys, "left_semi")


def k_core(edges: DataFrame, k: int, keys: list[str] = ["market_id"], task_edges: int = CORE_EDGES) -> DataFrame:
    """Edges of the k-core, where every node has at least ``k`` of them.

    A graph of at most ``task_edges`` edges is peeled inside one task.  Of a larger one
    a few layers are peeled off first, which is often all; if not, each connected component of what is left
    is peeled inside one task, however long its chains, and only a component
    larger than ``task_edges`` layer by layer, each a written table.
    """
    plain = cut(edges.select(*keys, "src", "dst", "weight").dropna(subset=[*keys, "src"]))
    small, large = by_size(plain, keys, task_edges)
    cores = None if small is None else _peeled_in_tasks(small, k, keys, [], task_edges)
    if large is None:
        return cores
    rest, done = _peeled_by_layers(large, k, keys, CORE_LAYERS)
    if not done:
        rest = _peeled_by_component(rest, k, keys, task_edges)
    return rest if cores is None else cores.unionByName(rest)


def _peeled_in_tasks(edges: DataFrame, k: int, keys: list[str], group: list[str], task_edges: int) -> DataFrame:
    """Cores of graphs told apart by ``keys`` (parts of them by ``group``), which share tasks up to about ``task_edges``."""
    n = edges.count()
    buckets = max(1, -(-n // task_edges), min(64, n // 1000))
    schema = edges.select(*keys, "src", "dst", "weight").schema

    def peel(rows: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([rows[[*keys, "src"]].set_axis([*keys, "node"], axis=1), rows[[*keys, "dst"]].set_axis([*keys, "node"], axis=1)])
        number = ends.groupby([*keys, "node"], sort=False, dropna=False).ngroup().to_numpy()
        alive = peeled(number[:len(rows)], number[len(rows):], int(number.max()) + 1, k)
        return rows.loc[alive, [*keys, "src", "dst", "weight"]]

    by = [*keys, *group]
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)) if by else F.lit(0)
    return edges.withColumn("_b", bucket).groupBy("_b").applyInPandas(peel, schema)


def _peeled_by_layers(edges: DataFrame, k: int, keys: list[str], layers: int | None = None) -> tuple[DataFrame, bool]:
    """(edges left, whether they are the core) after taking off so many layers of nodes with fewer than ``k`` edges."""
    taken = 0
    while True:
        gone = cut(degrees(edges, keys).where(F.col("degree") < k).drop("degree"))
        if gone.isEmpty():
            return edges, True
        if taken == layers:
            return edges, False
        edges = cut(edges.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti"))
        taken += 1


def _peeled_by_component(edges: DataFrame, k: int, keys: list[str], task_edges: int) -> DataFrame:
    member = connected(edges, keys).withColumnRenamed("node", "src")
    sized = cut(edges.join(member, [*keys, "src"]))
    counts = sized.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n"))
    giant = cut(counts.where(F.col("_n") > task_edges).select(*keys, "component"))
    cores = _peeled_in_tasks(sized.join(giant, [*keys, "component"], "left_anti"), k, keys, ["component"], task_edges)
    if giant.isEmpty():
        return cores
    current = cut(sized.join(giant, [*keys, "component"], "left_semi").select(*keys, "src", "dst", "weight"))
    return cores.unionByName(_peeled_by_layers(current, k, keys)[0])


#: Rounds in which a random half of the willing nodes move at once.
MIXED_ROUNDS = 8


#: Edges of a graph whose communities one task finds.
COMMUNITY_EDGES = 8_000_000

#: Cells (node, community) of the table of links that a task keeps from round to round.
LINK_CELLS = 8_000_000

#: Cells of a table that is summed in place, if most of them are hit.
DENSE_CELLS = 50_000_000


def communities(edges: DataFrame, keys: list[str] = ["market_id"], task_edges: int = COMMUNITY_EDGES) -> DataFrame:
    """(keys, node, community): modularity communities by synchronous local moves.

    In a round nodes look at their neighbours' communities and join the best one
    if that gains modularity.  When no node gains by moving, communities
    become nodes and the next level starts, until a level changes nothing.
    Deterministic for given edges, never joins what is not connected, and names a
    community by its smallest member.

    The rounds of a graph of at most ``task_edges`` edges run inside one task; a
    larger graph takes the same rounds as written tables.
    """
    whole = edges.select(*keys, "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight")).dropna(subset=[*keys, "src", "dst"])
    small, large = by_size(cut(whole), keys, task_edges)
    found = [] if small is None else [_communities_in_tasks(small, keys)]
    found += [] if large is None else [_communities_by_tables(large, keys)]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _communities_in_tasks(edges: DataFrame, keys: list[str]) -> DataFrame:
    schema = edges.select(*keys, F.col("src").alias("node"), F.col("src").alias("community")).schema

    def found(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        ends = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks], rows["src"].type).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = rank[ends.indices.to_numpy()]
        seed = np.zeros(len(order), np.int64)
        seed[number] = np.concatenate([rows["_hs"].to_numpy(), rows["_hd"].to_numpy()])
        group = local_moves(number[:n], number[n:], rows["weight"].to_numpy(), seed)
        names = ends.dictionary.take(pa.array(order))
        first = [pa.repeat(rows[c][0], len(order)) for c in keys]
        return pa.Table.from_arrays([*first, names, names.take(pa.array(group))], [*keys, "node", "community"])

    hashed = edges.withColumns({"_hs": F.xxhash64("src"), "_hd": F.xxhash64("dst")})
    return (hashed if keys else hashed.withColumn("_all", F.lit(0))).groupBy(*(keys or ["_all"])).applyInArrow(found, schema)


def drawn(seed: np.ndarray, turn: int) -> np.ndarray:
    """``xxhash64(node, turn)`` of nodes with the given ``xxhash64(node)``."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (seed.view(np.uint64) + p5 + np.uint64(4)) ^ (np.uint64(turn) * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def summed(s: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (s, d) in order, d below ``n``, with their weights summed."""
    key = s * n + d
    cells = (int(s.max(initial=-1)) + 1) * n
    if cells <= min(DENSE_CELLS, 8 * len(key)):
        there = np.flatnonzero(np.bincount(key, minlength=cells))
        return there // n, there % n, np.bincount(key, w, cells)[there]
    if (key[1:] > key[:-1]).all():  # distinct and in order already
        return s, d, w + 0.0
    key, at = np.unique(key, return_inverse=True)
    return key // n, key % n, np.bincount(at, w, len(key))


def local_moves(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Community of each node 0 to len(seed) - 1 of one graph: the levels of :func:`communities`; numbers follow the order of the names."""
    member = np.arange(len(seed))
    s, d, w = summed(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight]), len(seed))
    names = member  # of the nodes of a level
    for level in count():
        community = _moved(s, d, w, seed[names], level)
        if (community == np.arange(len(names))).all():
            return member
        kept, at = np.unique(community, return_inverse=True)
        least = np.full(len(kept), len(names))
        np.minimum.at(least, at, np.arange(len(names)))
        order = np.argsort(least)
        place = np.empty(len(kept), np.int64)
        place[order] = np.arange(len(kept))
        member = names[least[order]][place[at][np.searchsorted(names, member)]]
        names = names[least[order]]
        s, d, w = summed(place[at][s], place[at][d], w, len(kept))


def _moved(s: np.ndarray, d: np.ndarray, w: np.ndarray, seed: np.ndarray, level: int) -> np.ndarray:
    """One level: moves until no node wants to, as :func:`_local_moves` does them."""
    n = len(seed)
    deg = np.bincount(s, w, n)
    m2, outer = deg.sum(), s != d
    s, d, w = s[outer], d[outer], w[outer]
    first = np.searchsorted(s, np.arange(n + 1))
    nodes, community, links = np.arange(n), np.arange(n), None
    for rnd in count():
        tot = np.bincount(community, deg, n)
        if links is None:
            labels, at = np.unique(community, return_inverse=True)
            if rnd >= MIXED_ROUNDS and n * len(labels) <= min(LINK_CELLS, 4 * len(s)):
                cell = at[d] * n + s  # a row for each community, so that a move changes two rows
                links = np.bincount(cell, w, n * len(labels)).reshape(-1, n), np.bincount(cell, minlength=n * len(labels)).reshape(-1, n)
        if links is not None:
            to_tot = np.repeat(tot[labels][:, None], n, axis=1)
            to_tot[at, nodes] -= deg
            to_tot *= deg
            to_tot /= m2
            value = np.round(links[0] - to_tot, 10)
            value[links[1] == 0] = -np.inf
            best = len(labels) - 1 - np.argmax(value[::-1], axis=0)
            to, top, here = labels[best], value[best, nodes], value[at, nodes]
        else:
            a, c, sums = summed(s, at[d], w, len(labels))
            c = labels[c]
            own = community[a] == c
            value = np.round(sums - deg[a] * (tot[c] - np.where(own, deg[a], 0.0)) / m2, 10)
            to, top, here = community.copy(), np.full(n, -np.inf), np.full(n, -np.inf)
            if len(a):
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                top[a[begin]] = np.maximum.reduceat(value, begin)
                best = value == top[a]
                to[a[best]] = c[best]  # of equal ones the last is written last
            here[a[own]] = value[own]
        stay = np.where(np.isneginf(here), np.round(-deg * (tot[community] - deg) / m2, 10), here)
        wants = np.flatnonzero(top > stay + 1e-9)
        if not len(wants):
            return community
        turn = drawn(seed[wants], rnd + 97 * level)
        if rnd < MIXED_ROUNDS:
            chosen = wants[turn % 2 == 0]
        else:
            early = wants[np.lexsort((wants, turn))][::-1]
            least = np.full(n, -1)
            # of the moves at a community the one with the smallest hash is written last
            least[np.stack([community[early], to[early]], 1).ravel()] = np.repeat(early, 2)
            chosen = wants[(least[community[wants]] == wants) & (least[to[wants]] == wants)]
        if links is not None:
            column = np.searchsorted(labels, to[chosen])
            for node, gain in zip(chosen, column):
                ends, add = d[first[node]:first[node + 1]], w[first[node]:first[node + 1]]
                for table, by in ((links[0], add), (links[1], 1)):
                    table[at[node]][ends] -= by
                    table[gain][ends] += by
            at[chosen] = column
        community[chosen] = to[chosen]


def _communities_by_tables(edges: DataFrame, keys: list[str]) -> DataFrame:
    arcs = cut(both_ways(edges, keys))  # at higher levels src = dst arcs hold inner weight, both directions counted
    member = cut(arcs.select(*keys, F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for level in count():
        start = arcs.select(*keys, F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
        assign = _local_moves(arcs, start, keys, level)
        moved = assign.where("node <> community").limit(1).count()
        if not moved:
            break
        named = assign.groupBy(*keys, "community").agg(F.min("node").alias("_name"))
        assign = cut(assign.join(named, [*keys, "community"]).select(*keys, "node", F.col("_name").alias("community")))
        member = cut(member.withColumnRenamed("community", "_old").join(
            assign.withColumnRenamed("node", "_old"), [*keys, "_old"]).select(*keys, "node", "community"))
        a = assign.withColumnRenamed("node", "src").withColumnRenamed("community", "_cs")
        b = assign.withColumnRenamed("node", "dst").withColumnRenamed("community", "_cd")
        arcs = cut(arcs.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).groupBy(
            *keys, F.col("_cs").alias("src"), F.col("_cd").alias("dst")).agg(F.sum("weight").alias("weight")))
    names = member.groupBy(*keys, "community").agg(F.min("node").alias("_name"))
    return member.join(names, [*keys, "community"]).select(*keys, "node", F.col("_name").alias("community"))


def _local_moves(arcs: DataFrame, assign: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Moves until no node wants to.

    In the first rounds a random half of the nodes that gain by it move.  They can
    undo each other's gain, so from then on a round takes moves that have no
    community in common: of the moves that leave or enter a community the one with the smallest hash.
    What such moves gain adds up, so modularity only rises, which ends it, and
    many communities change in one round.
    """
    strength = arcs.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("weight").alias("deg"))
    total = strength.groupBy(*keys).agg(F.sum("deg").alias("m2"))
    nodes = strength.join(total, keys) if keys else strength.crossJoin(total)
    state = cut(nodes.join(assign, [*keys, "node"]))
    outer = cut(arcs.where("src <> dst"))
    for rnd in count():
        size = state.groupBy(*keys, "community").agg(F.sum("deg").alias("tot"))
        here = state.join(size, [*keys, "community"])
        far = here.select(*keys, F.col("node").alias("dst"), F.col("community").alias("_to"), F.col("tot").alias("_to_tot"))
        link = (outer.join(far, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node"), "_to")
                .agg(F.sum("weight").alias("w"), F.max("_to_tot").alias("_to_tot")))
        own = F.col("_to") == F.col("community")
        value = F.round(F.col("w") - F.col("deg") * (F.col("_to_tot") - F.when(own, F.col("deg")).otherwise(0.0)) / F.col("m2"), 10)
        best = here.join(link, [*keys, "node"], "left").withColumn("_value", value).groupBy(
            *keys, "node", "community", "deg", "m2", "tot").agg(
            F.max(F.struct("_value", own.alias("_stay"), "_to")).alias("_best"),
            F.max(F.when(own, F.col("_value"))).alias("_here"))
        # without a link inside its community a node only pays that community's size
        stay = F.coalesce("_here", F.round(-F.col("deg") * (F.col("tot") - F.col("deg")) / F.col("m2"), 10))
        wants = F.coalesce(F.col("_best._value") > stay + 1e-9, F.lit(False))
        draw = F.xxhash64("node", F.lit(rnd + 97 * level))
        plan = cut(best.select(*keys, "node", "deg", "m2", "community", F.when(wants, F.col("_best._to")).alias("_to"), F.struct(draw.alias("h"), "node").alias("_turn")))
        moves = plan.where("_to is not null")
        if moves.isEmpty():
            state = plan
            break
        if rnd < MIXED_ROUNDS:
            chosen = moves.where(F.pmod(F.col("_turn.h"), F.lit(2)) == 0).select(*keys, "node", "_to")
        else:
            ends = moves.select(*keys, "_turn", F.explode(F.array("community", "_to")).alias("c"))
            first = ends.groupBy(*keys, "c").agg(F.min("_turn").alias("_first"))
            alone = ends.join(first, [*keys, "c"]).where("_turn = _first").groupBy(*keys, F.col("_turn.node").alias("node")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
            chosen = moves.join(alone, [*keys, "node"], "left_semi").select(*keys, "node", "_to")
        state = cut(plan.drop("_to", "_turn").join(chosen, [*keys, "node"], "left").select(*keys, "node", "deg", "m2", F.coalesce("_to", "community").alias("community")))
    return state.select(*keys, "node", "community")


def modularity(edges: DataFrame, member: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    arcs = both_ways(edges, keys)
    a = member.select(*keys, F.col("node").alias("src"), F.col("community").alias("ca"))
    b = member.select(*keys, F.col("node").alias("dst"), F.col("community").alias("cb"))
    tagged = arcs.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    per = tagged.groupBy(*keys, F.col("ca").alias("community")).agg(
        F.sum("weight").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    m2 = F.sum("tot")
    return per.groupBy(*keys).agg((F.sum("inner") / m2 - F.sum(F.col("tot") * F.col("tot")) / (m2 * m2)).alias("modularity"))


def totals(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Number of edges and their weight for each of ``keys``; packed edges are counted where they are."""
    if "_edges" not in edges.columns:
        return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total_edge_weight"))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [pickle.loads(v.as_py()).weight for v in batch.column("_edges")]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([len(w) for w in held], pa.int64()), pa.array([float(w.sum()) for w in held], pa.float64())],
                                          names=[*keys, "n_edges", "total_edge_weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(counted, batches)

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    parts = edges.select(*keys, "_edges").mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["n_edges long", "total_edge_weight double"]))
    return parts.groupBy(*keys).agg(F.coalesce(F.sum("n_edges"), F.lit(0).cast("long")).alias("n_edges"), F.sum("total_edge_weight").alias("total_edge_weight"))


def cluster_metadata(edges: DataFrame, member: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """Size, inner edges, density and weight of each community; ``edges`` are all edges, or those made ``within`` the communities."""
    if "community" not in edges.columns:
        a = member.select(*keys, F.col("node").alias("src"), "community").hint("merge")
        b = member.select(*keys, F.col("node").alias("dst"), F.col("community").alias("_cb")).hint("merge")
        edges = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where("community = _cb")
    inner = totals(edges, [*keys, "community"])
    size = member.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("size"))
    df = size.join(inner, [*keys, "community"], "left").fillna(0, ["n_edges"]).fillna(0.0, ["total_edge_weight"])
    most = F.col("size") * (F.col("size") - 1) / 2.0
    return df.withColumn("density", F.when(most > 0, F.col("n_edges") / most).otherwise(0.0))


def suspicious_clusters(meta: DataFrame, cfg: dict) -> DataFrame:
    a = cfg["attribution"]
    return meta.where((F.col("size") >= a["min_size_for_attribution"]) & (F.col("density") >= a["min_density_for_attribution"]))


def intra_cluster_transfers(transfers: DataFrame, member: DataFrame, keys: list[str] = ["market_id"], before_s: int | None = None) -> DataFrame:
    """Transfers between different wallets of the same community, summed per pair.

    A wallet's communities are one array, so a pair of wallets stays one row until
    it is known which of them its two ends share.
    """
    t = transfers.select(F.lower("from_address").alias("src"), F.lower("to_address").alias("dst"), "timestamp_s", "value_usdc")
    t = t.where(F.col("src") != F.col("dst"))
    if before_s is not None:
        t = t.where(F.col("timestamp_s") < before_s)
    # sum per pair first: the transfers table shrinks before it meets the graphs
    pairs = t.groupBy("src", "dst").agg(F.sum("value_usdc").alias("amount"), F.count(F.lit(1)).alias("tx_count"))
    k = [*keys, "community"]
    counted = member.select(F.lower("node").alias("_w"), *k).dropna().groupBy("_w", *k).agg(F.count(F.lit(1)).alias("_n"))
    held = cut(counted.groupBy("_w").agg(F.collect_list(F.struct(*k)).alias("_in"), F.max("_n").alias("_most")))
    of = lambda end: held.select(F.col("_w").alias(end), F.col("_in").alias(f"_in_{end}"))
    met = pairs.join(of("src"), "src").join(of("dst"), "dst").withColumn("_both", F.array_intersect("_in_src", "_in_dst"))
    links = met.where(F.size("_both") > 0).select("src", "dst", "amount", "tx_count", F.explode("_both").alias("_at")).select("*", *[F.col(f"_at.{c}").alias(c) for c in k])
    if not held.where("_most > 1").isEmpty():  # a member that is listed n times has its links n times
        times = lambda end: counted.where("_n > 1").select(F.col("_w").alias(end), *k, F.col("_n").alias(f"_n_{end}"))
        links = links.join(times("src"), [*k, "src"], "left").join(times("dst"), [*k, "dst"], "left").withColumn("_copy", F.explode(
            F.sequence(F.lit(1).cast("long"), F.coalesce("_n_src", F.lit(1)) * F.coalesce("_n_dst", F.lit(1)))))
    return links.select(*k, "src", "dst", "amount", "tx_count")


def ownership(links: DataFrame, cfg: dict, keys: list[str] = ["market_id"]) -> DataFrame:
    """Per community: inner transfer edges, two-way pairs, total, pattern text."""
    k = [*keys, "community"]
    # a pair is two-way when both directions exist
    undirected = links.groupBy(*k, F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(
        F.count(F.lit(1)).alias("_dirs"), F.sum("amount").alias("_amount"))
    agg = undirected.groupBy(*k).agg(
        F.sum("_dirs").alias("intra_edges"), F.count_if(F.col("_dirs") > 1).alias("bidirectional_pairs"),
        F.sum("_amount").alias("total_transfer_amount"))
    pattern = F.when(F.col("bidirectional_pairs") > 0, F.format_string("Bidirectional transfers (%d pairs)", "bidirectional_pairs")).otherwise(
        F.format_string("Unidirectional transfers (%d edges)", "intra_edges"))
    return agg.withColumns({
        "has_common_ownership": F.col("intra_edges") >= cfg["attribution"]["ownership_flag_threshold"], "pattern": pattern})


def cluster_boost(cfg: dict) -> Column:
    b = cfg["cluster_boost"]
    raw = (F.lit(1.0) + F.least(F.col("size") / b["size_normalizer"], F.lit(b["size_weight"]))
           + F.col("density") * b["density_weight"]
           + F.when(F.col("has_common_ownership"), b["ownership_boost"]).otherwise(0.0))
    return F.least(raw, F.lit(b["max_boost_factor"]))


def clusters(trades: DataFrame, cfg: dict, keys: list[str] = ["market_id"], transfers: DataFrame | None = None,
             sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(member, metadata with ownership and boost) of each graph."""
    c = cfg["clustering"]
    sizes = bucket_sizes(trades, cfg, keys) if sizes is None else sizes
    # both are read several times: written once, they are found once
    core = cut(k_core(edges_from_sizes(sizes, cfg, keys, c["min_edge_weight"]), c["k_core"], keys))
    member = cut(communities(core, keys))
    meta = cluster_metadata(core, member, keys)
    if transfers is not None:
        wanted = member.join(suspicious_clusters(meta, cfg).select(*keys, "community"), [*keys, "community"], "left_semi")
        owned = ownership(intra_cluster_transfers(transfers, wanted, keys), cfg, keys)
        meta = meta.join(owned.select(*keys, "community", "has_common_ownership"), [*keys, "community"], "left")
    else:
        meta = meta.withColumn("has_common_ownership", F.lit(False))
    meta = meta.withColumn("has_common_ownership", F.coalesce("has_common_ownership", F.lit(False)))
    return member, meta.withColumn("boost", cluster_boost(cfg))


def wallet_boosts(member: DataFrame, meta: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    return (member.join(meta.hint("merge"), [*keys, "community"])
            .select(*keys, F.col("node").alias("wallet"), F.col("community").alias("cluster_id"),
                    F.col("size").alias("cluster_size"), F.col("density").alias("cluster_density"), "has_common_ownership", "boost"))


def apply_wallet_boosts(rows: DataFrame, boosts: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """Left join boosts; wallets in no cluster get boost 1 and no ownership."""
    out = rows.join(boosts, [*keys, "wallet"], "left")
    return out.withColumns({"boost": F.coalesce("boost", F.lit(1.0)),
                            "has_common_ownership": F.coalesce("has_common_ownership", F.lit(False))})


def edge_consistency(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges naming unknown wallets, and whether there are more than n(n-1)/2."""
    k = known.select(F.col("wallet").alias("_w"))
    bad = edges.join(k.withColumnRenamed("_w", "src").withColumn("_s", F.lit(1)), "src", "left").join(
        k.withColumnRenamed("_w", "dst").withColumn("_d", F.lit(1)), "dst", "left")
    n = known.agg(F.count(F.lit(1)).alias("n_wallets"))
    agg = bad.agg(F.count(F.lit(1)).alias("n_edges"),
                  F.count_if(F.col("_s").isNull() | F.col("_d").isNull()).alias("unknown_edges"))
    most = F.col("n_wallets") * (F.col("n_wallets") - 1) / 2
    return agg.crossJoin(n).withColumn("too_many_edges", F.col("n_edges") > most)
