"""Hard negatives from rotated one-bit codes.

A vector's components become whole numbers, floor(``SCALE`` * x).  A fixed random
rotation (sign flips and Hadamard transforms) spreads them, and the signs of the
rotated components are its code.  With the code are stored the vector's length
and its alignment: the inner product a of the unit vector and the unit vector of
its signs.  An anchor is rotated too and written in seven bit planes, so its inner product t
with a code comes from popcounts, up to a known rounding error.  What the code
leaves out is orthogonal to it, so by Cauchy and Schwarz the score of a row lies within
    |x| (a t  -+  sqrt(1 - a^2) sqrt(|q|^2 - t^2)),
always.  A row is scored in whole numbers only where this interval reaches what
an anchor can still use; the others cannot be among its results.

Anchors are taken in blocks of bounded size, each against all rows: one pass finds the
nearest rows of the same label (positives), a second the rows of other labels
whose score stands in the asked proportion to a positive's (negatives).  Tasks
return at most k rows for each anchor, or anchor and positive.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; rows that repeat an id are rows each (of equal scores
and ids any may come first); shorter vectors count as padded with zeros; components are clamped to
+-2^24 after scaling; a zero vector scores 0 with everything; an anchor without
positives, or a positive without negatives, gives no rows; so does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapescope.llm.common import map_batches, shared_path, written

SCALE, CLAMP, PLANES, ROUNDS = 256, 1 << 24, 7, 3
#: Anchors of one block, and rows and anchors that are compared at a time.
ANCHORS, TILE_ROWS, TILE_ANCHORS = 4096, 512, 256
_NONE = np.iinfo(np.int64).min


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows of ``x``, their width a power of two, under a fixed orthogonal map."""
    n, width = x.shape
    signs = np.random.default_rng(11).choice([-1.0, 1.0], (ROUNDS, width))
    x = x.astype(float)
    for flips in signs:
        x, step = x * flips, 1
        while step < width:
            x = x.reshape(n, -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            step *= 2
        x = x.reshape(n, width) / np.sqrt(width)
    return x


def width_of(dim: int) -> int:
    """Power of two, at least 64, that holds ``dim`` components."""
    return max(64, 1 << max(dim - 1, 0).bit_length())


def coded(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, length, alignment) of each row."""
    turned = rotated(ints)
    code = np.packbits(turned >= 0, axis=1).view(np.uint64)
    norm = np.sqrt((turned**2).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        align = np.where(norm > 0, np.abs(turned).sum(axis=1) / (norm * np.sqrt(turned.shape[1])), 1.0)
    return code, norm, np.minimum(align, 1.0)


@dataclass
class Anchors:
    """One block of anchors: their rows, and their bit planes for popcounts."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    planes: np.ndarray  # (anchors, PLANES, words)
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    norm: np.ndarray
    rounding: np.ndarray

    @classmethod
    def of(cls, row, vec_id, label, ints) -> Anchors:
        turned = rotated(ints)
        low = turned.min(axis=1, initial=0)
        step = np.maximum(turned.max(axis=1, initial=0) - low, 1e-300) / ((1 << PLANES) - 1)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        planes = np.stack([np.packbits((level >> p) & 1 == 1, axis=1).view(np.uint64) for p in range(PLANES)], axis=1)
        rounding = np.abs(turned - low[:, None] - step[:, None] * level).sum(axis=1) / np.sqrt(turned.shape[1])
        return cls(row, vec_id, label, ints, planes, low, step, level.sum(axis=1), np.sqrt((turned**2).sum(axis=1)), rounding)

    def take(self, which) -> Anchors:
        return Anchors(**{name: value[which] for name, value in vars(self).items()})


def intervals(code: np.ndarray, norm: np.ndarray, align: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible score of every row (down) with every anchor (across).

    Single precision, with room for its rounding on both sides.
    """
    width, f32 = 64 * code.shape[1], np.float32
    picked = np.zeros((len(code), len(anchors.row)), np.uint16 if width <= 512 else np.uint32)
    for p in range(PLANES):
        for w in range(code.shape[1]):
            picked += np.bitwise_count(code[:, w, None] & anchors.planes[None, :, p, w]).astype(picked.dtype) << p
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    root = np.sqrt(width)
    along = picked * (2 * anchors.step / root).astype(f32)
    along += (2 * ones - width).astype(f32)[:, None] * (anchors.low / root).astype(f32) - (anchors.step * anchors.total / root).astype(f32)
    rest = np.maximum(np.abs(along) - anchors.rounding.astype(f32), 0)
    rest = np.sqrt(np.maximum((anchors.norm**2).astype(f32) - rest * rest, 0))
    rest *= np.sqrt(np.maximum(1 - align**2, 0)).astype(f32)[:, None]
    rest += align.astype(f32)[:, None] * anchors.rounding.astype(f32) + f32(1e-3) * anchors.norm.astype(f32)
    along *= align.astype(f32)[:, None]
    scale = norm.astype(f32)[:, None]
    return scale * (along - rest) - 1, scale * (along + rest) + 1


def scored(rows: np.ndarray, anchors: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whole-number scores where ``wanted``, else the smallest integer."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * rows.shape[1]
    n = np.count_nonzero(wanted)
    if most < 1 << 53 and 8 * n > wanted.size:  # many survive: sums of whole numbers this small are exact as floating-point numbers
        kind = np.float32 if most < 1 << 24 else np.float64
        return np.where(wanted, (rows.astype(kind) @ anchors.astype(kind).T).astype(np.int64), _NONE)
    out = np.full(wanted.shape, _NONE)
    r, a = np.nonzero(wanted)
    for at in range(0, n, 65536):
        x, y = r[at:at + 65536], a[at:at + 65536]
        out[x, y] = (rows[x] * anchors[y]).sum(axis=1)
    return out


class Best:
    """The first ``k`` (score falling, id rising) for each of ``n`` keys, over many calls."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.floor = k, np.empty((0, 4), np.int64), np.full(n, _NONE + 1)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        better = score >= self.floor[key]
        key, score, vec_id, row = key[better], score[better], vec_id[better], row[better]
        if not len(key):
            return
        every = np.vstack([self.rows, np.column_stack([key, score, vec_id, row])])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        starts = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
        place = np.arange(len(every)) - np.repeat(starts, np.diff(np.append(starts, len(every))))
        self.rows = every[place < self.k]
        last = every[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]


# ---- Spark

_ROWS = "row long, vec_id long, label long, is_anchor boolean, ints binary, code binary, norm double, align double"


def codes(vectors: DataFrame, dim: int) -> DataFrame:
    """One coded row for every valid row of ``vectors`` (vec_id, label, embedding, is_anchor)."""
    width = width_of(dim)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ints = np.zeros((batch.num_rows, width), np.int64)
        for i, x in enumerate(batch.column(4)):
            x = np.clip(np.floor(SCALE * np.asarray(x.values.to_numpy(zero_copy_only=False), float)), -CLAMP, CLAMP)
            ints[i, :len(x)] = x
        code, norm, align = coded(ints)
        packed = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:4], packed(ints.astype(np.int32)), packed(code), pa.array(norm), pa.array(align)],
                                          names=["row", "vec_id", "label", "is_anchor", "ints", "code", "norm", "align"])

    return map_batches(vectors.select("row", "vec_id", "label", "is_anchor", "embedding"), run, _ROWS)


def _numbers(batch: pa.RecordBatch | pa.Table) -> tuple:
    n = batch.num_rows
    matrix = lambda name, dtype: np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype).reshape(n, -1)
    row, vec_id, label = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
    return row, vec_id, label, matrix("ints", np.int32).astype(np.int64), matrix("code", np.uint64), batch.column("norm").to_numpy(), batch.column("align").to_numpy()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= TILE_ROWS:
            yield _numbers(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield _numbers(pa.Table.from_batches(held))


def _nearest(rows: DataFrame, shared, k: int) -> DataFrame:
    """(anchor, score, vec_id, row): the first ``k`` other rows of the anchor's label, of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = Best(len(anchors.row), k)
        by_label = {int(x): np.flatnonzero(anchors.label == x) for x in np.unique(anchors.label)}
        for row, vec_id, label, ints, code, norm, align in _tiles(batches):
            for x in np.unique(label):
                mine, own = np.flatnonzero(label == x), by_label.get(int(x), ())
                for at in range(0, len(own), TILE_ANCHORS):
                    of = own[at:at + TILE_ANCHORS]
                    some, other = anchors.take(of), row[mine][:, None] != anchors.row[of]
                    low, high = intervals(code[mine], norm[mine], align[mine], some)
                    floor = best.floor[of].astype(float)
                    if len(mine) > k:  # k rows are certain to reach this
                        floor = np.maximum(floor, np.partition(np.where(other, low, -np.inf), len(mine) - k, axis=0)[len(mine) - k])
                    score = scored(ints[mine], some.ints, other & (high >= floor))
                    r, a = np.nonzero(score >= best.floor[of])
                    best.add(of[a], score[r, a], vec_id[mine][r], row[mine][r])
        yield _batch(best.rows, ["anchor", "score", "vec_id", "row"])

    return rows.mapInArrow(run, "anchor long, score long, vec_id long, row long")


def _batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=names)


def _between(rows: DataFrame, shared, positives, k: int, low_percent: int, high_percent: int) -> DataFrame:
    """(place of the positive, score, vec_id, row): the first ``k`` rows of other labels in each positive's range, of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (of, score_of) = shared.value, positives.value
        low_of, high_of = -(-low_percent * score_of // 100), high_percent * score_of // 100  # whole scores s with low <= 100 s <= high
        best = Best(len(of), k)
        # the places of an anchor's positives stand together
        first = np.searchsorted(of, np.arange(len(anchors.row) + 1))
        each = int(np.diff(first).max(initial=0))
        for row, vec_id, label, ints, code, norm, align in _tiles(batches):
            floor = np.maximum(low_of, best.floor)
            asked = floor <= high_of
            least, most = np.full(len(anchors.row), np.inf), np.full(len(anchors.row), -np.inf)
            np.minimum.at(least, of[asked], floor[asked])
            np.maximum.at(most, of[asked], high_of[asked])
            for at in range(0, len(anchors.row), TILE_ANCHORS):
                part = slice(at, at + TILE_ANCHORS)
                some = anchors.take(part)
                low, high = intervals(code, norm, align, some)
                score = scored(ints, some.ints, (label[:, None] != some.label) & (high >= least[part]) & (low <= most[part]))
                r, a = np.nonzero((score >= least[part]) & (score <= most[part]))
                s, a = score[r, a], a + at
                for j in range(each):
                    place = first[a] + j
                    fits = np.flatnonzero(place < first[a + 1])
                    fits = fits[(s[fits] >= floor[place[fits]]) & (s[fits] <= high_of[place[fits]])]
                    best.add(place[fits], s[fits], vec_id[r[fits]], row[r[fits]])
        yield _batch(best.rows, ["place", "score", "vec_id", "row"])

    return rows.mapInArrow(run, "place long, score long, vec_id long, row long")


def _first(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id, label and every component of the vector known and finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(known & ~F.coalesce(F.exists("embedding", odd), F.lit(True)))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label, embedding and is_anchor.  For each anchor and
    each of its ``positives`` nearest rows of the same label: the first
    ``negatives`` rows of other labels whose score is between the two percentages
    of the positive's.
    """
    spark = vectors.sparkSession
    rows = valid(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = written(codes(rows, dim), "codes")
    n_blocks = max(1, -(-rows.where("is_anchor").count() // block))
    path = shared_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(n_blocks):
        # at most about ``block`` rows reach the driver, whatever the table's size
        mine_ = rows.where(F.col("is_anchor") & (F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b)).select("row", "vec_id", "label", "ints", "code", "norm", "align").toArrow()
        if not mine_.num_rows:
            continue
        row, vec_id, label, ints, *_ = _numbers(mine_)
        shared = spark.sparkContext.broadcast(Anchors.of(row, vec_id, label, ints))
        near = _first(_nearest(rows, shared, positives), "anchor", positives).select("anchor", "score", "vec_id").orderBy("anchor", F.desc("score"), "vec_id").toArrow()
        of, score, positive = (near.column(c).to_numpy() for c in ("anchor", "score", "vec_id"))
        known = spark.sparkContext.broadcast((of, score))
        found = _first(_between(rows, shared, known, negatives, low_percent, high_percent), "place", negatives)
        places = spark.createDataFrame(pa.table({"place": np.arange(len(of)), "anchor_id": vec_id[of], "positive_id": positive, "positive_score": score}).to_pandas(),
                                       "place long, anchor_id long, positive_id long, positive_score long")
        found.join(F.broadcast(places), "place").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                                                       F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
