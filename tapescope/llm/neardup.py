"""Near-duplicate documents by HyperMinHash sketches, banding and exact checks.

A document's set is hashed shingle by shingle.  One hash puts a shingle into a
bucket; of each bucket the smallest value is kept as a register: its number of
leading zeros and ten bits of mantissa.  Empty buckets borrow the register of the
first filled bucket in a fixed order of their own, so every register agrees
between two documents with the probability of their Jaccard similarity.  Bands of
seven registers make keys; at a similarity of 0.8 a pair shares none of the 73
keys with a probability of 4e-8.

Documents with equal sets are one node.  Nodes that share keys, directly or
through others, are a family.  The full sets of a family travel to one task, a
large family to several: its nodes are dealt into blocks of bounded size, twice,
and then every two blocks that a key with unlike groups spans meet in one task.
Inside a task a node is compared with the nodes of other groups: first by
registers, corrected for chance collisions and with a margin of seven standard
deviations, then what passes on the full sets.  A verified link joins two groups,
and pairs inside a group are skipped, so only links of a spanning forest leave
the task and no row stands for a pair.  Groups are connected components, found by
large-star and small-star rounds over written tables.

Defined cases: a document without words has no shingles and is alone; one with
fewer words than a shingle has its whole sequence as one; rows that repeat a
doc_id are rows each; a row without doc_id gets the smallest id of its group, or
null, and is kept only if it has none to follow; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapescope.llm.common import map_batches, written

BUCKET_BITS, MANTISSA_BITS, ROWS_PER_BAND = 9, 10, 7
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS_PER_BAND
#: Chance that two different minima fall on the same register: equal zeros (about 1/3) and equal mantissa.
COLLISION = 1 / (3 << MANTISSA_BITS)
#: Sets one block holds, and their shingles together (a sketch counts as 128); a task holds one block, or two.
BLOCK_NODES, BLOCK_WEIGHT = 8192, 4_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, _U)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    size, last = (n, 1) if n < size else (size, n - size + 1)
    out = np.full(last, size, _U)
    for j in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashed[j:j + last])
    return np.unique(out)


@lru_cache(1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket an order of all buckets, and the place of each bucket in it."""
    order = np.argsort(np.random.default_rng(5).random((BUCKETS, BUCKETS)), axis=1).astype(np.uint16)
    place = np.empty_like(order)
    np.put_along_axis(place, order.astype(np.int64), np.arange(BUCKETS, dtype=np.uint16)[None, :], axis=1)
    return order, place


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set, empty buckets filled."""
    h = np.sort(_mix(shingles ^ _U(0xD6E8FEB86659FD93)))
    bucket = (h >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest value of each bucket
    fraction, exponent = np.frexp(((h[first] >> _U(3)) & _U((1 << 52) - 1)).astype(float))
    zeros = 52 - exponent
    mantissa = np.where(fraction > 0, (2 * fraction - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out = np.zeros(BUCKETS, np.uint16)
    filled = bucket[first]
    out[filled] = (zeros << MANTISSA_BITS) + mantissa + 1
    empty = np.flatnonzero(out == 0)
    if len(empty):
        order, place = _orders()
        source = out.copy()
        for step in range(8 if len(filled) > 64 else 0):
            got = source[order[empty, step]]
            out[empty] = got
            empty = empty[got == 0]
            if not len(empty):
                break
        if len(empty):
            out[empty] = source[filled[place[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands of one sketch a row."""
    n = len(regs)
    bands = np.zeros((n, BANDS, 8), np.uint16)
    bands[:, :, :ROWS_PER_BAND] = regs[:, :BANDS * ROWS_PER_BAND].reshape(n, BANDS, ROWS_PER_BAND)
    words = bands.view(np.uint64).reshape(n, BANDS, 2)
    with np.errstate(over="ignore"):
        return _mix(_mix(words[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) + words[:, :, 1]).view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches, row by row, corrected for chance collisions."""
    return ((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION)


def margin(n: np.ndarray, threshold: float, deviations: float = 7) -> np.ndarray:
    """Deviations of an estimate at ``threshold`` for sets of at least ``n`` shingles.

    Filled buckets sample the union without replacement, borrowed registers
    weigh them at random.  Small sets, for which this is no guide, get 1.
    """
    spread = threshold * (1 - threshold)
    filled = np.maximum(BUCKETS * -np.expm1(n * np.log1p(-1 / BUCKETS)), 1)
    variance = spread * np.maximum(1 - filled * threshold / np.maximum(n, 1), 0) / filled + spread * (BUCKETS - filled) / BUCKETS**2
    return np.where(n < 64, 1.0, deviations * np.sqrt(variance))


def similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted non-empty sets ``others`` are linked with the sorted set ``own``."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    at = np.searchsorted(own, every)
    shared = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * shared >= percent * (len(own) + sizes - shared)


def spanning(groups: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places of two sets) that join all groups which any link joins.

    Every pair of sets in different groups is compared, until its groups are one.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    root, found = np.unique(groups, return_inverse=True)[1], []
    for v in range(1, len(sets)):
        left = np.flatnonzero((root[:v] != root[v]) & (100 * np.minimum(n[:v], n[v]) >= percent * np.maximum(n[:v], n[v])))
        step = 16
        while len(left):
            some, left = left[-step:], left[:-step]
            some = some[estimated(regs[some], regs[v]) >= percent / 100 - margin(np.minimum(n[some], n[v]), percent / 100)]
            if len(some):
                for u in some[similar(sets[v], [sets[u] for u in some], percent)]:
                    if root[u] != root[v]:
                        found.append((int(u), v))
                        root[root == root[u]] = root[v]
                left = left[root[left] != root[v]]
            step *= 4
    return found


# ---- Spark

def _sketches(docs: DataFrame, size: int, carry: list[str]) -> DataFrame:
    """The columns ``carry``, x (hash of the text), n, h1, h2 (identity of the set), regs."""
    kept = docs.select(*carry, F.xxhash64(F.col("text").cast("string")).alias("x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n long, h1 long, h2 long, regs binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, identity, regs = [], [], []
        for text in batch.column(batch.num_columns - 1):
            s = shingle_set(text.as_py(), size)
            counts.append(len(s))
            identity.append(_identity(s))
            regs.append(registers(s).tobytes() if len(s) else None)
        more = [pa.array(counts, pa.int64()), *(pa.array([i[k] for i in identity], pa.int64()) for k in (0, 1)), pa.array(regs, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "n", "h1", "h2", "regs"])

    return map_batches(docs.select(*carry, F.xxhash64(F.col("text").cast("string")).alias("x"), F.col("text").cast("string").alias("_text")), run, schema)


def _identity(s: np.ndarray) -> tuple[int, int]:
    h = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(h[0]), int(h[1])


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(key, node): one row for each band of each node."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(band_keys(regs).reshape(-1), pa.int64()), pa.array(node, pa.int64())], names=["key", "node"])

    return map_batches(nodes.select("node", "regs"), run, "key long, node long")


def _with_sets(docs: DataFrame, id_column: str, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` (at, x, h1, h2, ..) with ``s``, the set of the text that has this id and hash."""
    texts = docs.select(F.col(id_column).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_x"), F.col("text").cast("string").alias("_text"))
    both = wanted.join(texts, (F.col("x") == F.col("_x")) & F.col("at").eqNullSafe(F.col("_id")))
    names = [c for c in wanted.columns if c not in ("at", "x", "h1", "h2")]
    schema = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names) + ", s binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), size) for t in batch.column(2)]
        right = [_identity(s) == (h1, h2) for s, h1, h2 in zip(sets, batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        out = pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "s"])
        return out.filter(pa.array(right, pa.bool_()))

    return map_batches(both.select("h1", "h2", "_text", *names), run, schema)


def _compare(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) inside the tasks that ``keys`` name; rows have node, label and s, from which the registers are made again."""
    rows = rows.select(*keys, "node", "label", "s").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, len(keys)):
            node, first = np.unique(block.column("node").to_numpy(), return_index=True)  # a text may stand in several rows
            if len(node) < 2:
                continue
            block = block.take(pa.array(first))
            sets = [np.frombuffer(v.as_buffer(), _U) for v in block.column("s")]
            links = spanning(block.column("label").to_numpy(), sets, np.stack([registers(s) for s in sets]), percent)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of one key after the other; the batches come in the order of their keys."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and tuple(keys[a]) != current:
                yield pa.Table.from_batches(held)
                held = []
            current = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the smallest node of its component."""
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    while True:
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen or not sums[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        seen = sums
        # large star: every larger neighbour is linked to the smallest one
        sym = pairs.union(pairs.select("v", "u"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")
        # small star: smaller neighbours and the node itself are linked to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.union(least).distinct(), "cc")


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` (node, root) after new edges: only components they touch are linked anew."""
    if labels is None:
        return written(components(edges), "labels")
    if edges.isEmpty():
        return labels
    between = _labelled(_labelled(edges, labels, "a").withColumnRenamed("label", "_a"), labels, "b").select(F.col("_a").alias("a"), F.col("label").alias("b"))
    new = written(components(between), "joined")
    old = labels.join(new.toDF("root", "_to"), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return written(old.union(new.join(labels, "node", "left_anti").select("node", "root")), "labels")


#: Rows that share a key of many parts look their number up under this many salts.
SALTS = 16


def _in_parts(rows: DataFrame, key: str, limits: tuple[int, int]) -> DataFrame:
    """``rows`` (node, n, ..) with ``parts``: over how many blocks the rows of their key have to be dealt."""
    nodes, weight = limits
    sums = rows.groupBy(key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / nodes), F.ceil(F.sum(F.col("n") + 128) / weight)).cast("long").alias("parts"))
    large = written(sums.where("parts > 1"), "large")
    if large.isEmpty():
        return rows.withColumn("parts", F.lit(1).cast("long"))
    large = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(large, [key, "_salt"], "left").drop("_salt").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))


def labelled(docs: DataFrame, shingle: int, percent: int, id_column: str, carry: list[str], limits: tuple[int, int] = (BLOCK_NODES, BLOCK_WEIGHT)) -> DataFrame:
    """The columns ``carry`` of every row of ``docs``, with n (size of its set) and ``group`` (null for an empty set)."""
    sketches = written(_sketches(docs, shingle, carry), "sketches")
    nodes = written(sketches.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col(id_column).alias("at"), "x")).alias("_at"), F.first("n").alias("n"), F.first("regs").alias("regs")).select(
        F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "regs", "_at.*"), "nodes")

    # families: nodes that share keys
    bands = _band_rows(nodes)
    shared = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "leader")
    members = written(bands.join(shared, "key"), "members")
    family = components(members.select(F.col("leader").alias("a"), F.col("node").alias("b"))).toDF("node", "family")
    placed = written(_in_parts(family.join(nodes.select("node", "n"), "node"), "family", limits).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts"))), "placed")

    def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
        full = rows.join(nodes.select("node", "at", "x", "h1", "h2"), "node")  # narrow: only sets travel
        return written(_compare(_with_sets(docs, id_column, full, shingle), keys, percent), "links")

    labels = merged(None, compared(placed.withColumn("label", F.col("node")), ["family", "block"]))
    large = written(placed.where("parts > 1"), "large")
    if not large.isEmpty():
        # another deal joins most of what one group is, whatever block it fell into
        again = _labelled(large, labels).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
        labels = merged(labels, compared(again, ["family", "block"]))
        labels = merged(labels, _across(members, large, labels, compared, limits))

    found = _labelled(nodes.select("node", "h1", "h2"), labels).select("h1", "h2", F.col("label").alias("group"))
    return sketches.select(*carry, "n", "h1", "h2").join(found, ["h1", "h2"], "left").drop("h1", "h2")


def _across(members: DataFrame, large: DataFrame, labels: DataFrame, compared, limits: tuple[int, int]) -> DataFrame:
    """Links between blocks of the families in ``large``: every two blocks that a key with unlike groups spans."""
    left = _labelled(members.select("key", "node").join(large.select("node", "n", "family", "parts"), "node"), labels)
    mixed = left.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = written(left.join(mixed, "key"), "left")
    nodes = left.select("node", "n", "family", "label", F.col("parts").alias("of_family")).distinct()
    # a group of more than a block has blocks of its own; the others share the blocks of their family
    nodes = _in_parts(nodes, "label", limits).withColumn("block", F.when(F.col("parts") > 1, F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(
        F.xxhash64("family", F.pmod(F.xxhash64("label"), F.col("of_family")), F.lit("shared"))))
    nodes = written(nodes.select("node", "label", "block"), "blocks")
    touched = written(left.select("key", "node").join(nodes, "node").groupBy("key", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "touched")
    other = touched.toDF("key", "block2", "lo2", "hi2")
    meet = touched.join(other, "key").where("block <= block2 and least(lo, lo2) <> greatest(hi, hi2)").select("block", "block2").distinct()
    meet = written(meet.withColumn("task", F.monotonically_increasing_id()), "meet")
    tasks = meet.select("block", "task").union(meet.select("block2", "task")).distinct()
    return compared(nodes.join(tasks, "block"), ["task"])


def _labelled(rows: DataFrame, labels: DataFrame, column: str = "node") -> DataFrame:
    """``rows`` with ``label``, the group of the node in ``column``."""
    own = labels.toDF(column, "label")
    return rows.join(own, column, "left").withColumn("label", F.coalesce("label", column))


def grouped(docs: DataFrame, shingle: int = 5, percent: int = 80, limits: tuple[int, int] = (BLOCK_NODES, BLOCK_WEIGHT)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= percent * union of their
    sets of ``shingle``-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(labelled(docs, shingle, percent, "doc_id", ["doc_id"], limits), "found")
    least = found.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id")
    return found.join(least, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
