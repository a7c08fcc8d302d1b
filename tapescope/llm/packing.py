"""Packing token sequences by cutting-stock column generation.

``tokenize`` cuts every document's ids into full windows and one rest.  Piece
lengths are rounded up to a class of ``GRAIN`` tokens, so their histogram has at
most ``capacity / GRAIN`` rows whatever the corpus; only that histogram reaches
the driver.  There a linear program over patterns (how many pieces of each class
share a sequence) is solved by column generation: a knapsack over the capacity
prices new patterns with the duals until none improves.  Pattern counts are
rounded down, the few left-over pieces are placed best-fit decreasing.  Pieces
are ranked inside their class by a hash, in buckets of bounded size, and the rank
tells pattern, copy and slot.

Defined cases: null or empty text is a document of the end id alone; repeated
documents are packed each; null doc_id is kept as null; an empty table gives no
rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapescope.llm.common import written

CAPACITY, GRAIN, END_ID = 2048, 8, 1
#: Pieces one ranking task holds, and words in one generation of a worker's word cache.
BUCKET_ROWS, CACHE_WORDS = 200_000, 500_000
#: Arrow bytes in one batch of pieces.
OUT_BYTES = 4 << 20

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

#: Pivots after which the inverse of the basis is computed anew.
REFRESH = 400

#: White space for the tokenizer or for Python, but not for both in the same way.
_ODD_SPACE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                               0x205F, 0x3000))) + "]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of letters that are their own composed form, in any case.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write the bytes that have no visible Latin-1 character: from 256 on, in order."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: 256 + k for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a text as little-endian unsigned numbers of ``width`` bytes, word by word.

    White space separates words for this tokenizer, and no normalisation or
    merge crosses it, so a text's ids are those of its words in order.  Words
    are kept in two generations of bounded size.
    """

    def __init__(self, path: str, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.dtype, self.letters = f"<u{width}", _byte_letters()
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"the vocabulary does not fit in {width} bytes an id")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        got = self.new.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                got = self._encode(word)
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def _encode(self, word: str) -> bytes:
        if word.isascii():
            lower = word.lower()
            if lower.isalpha():  # one pre-token: straight to the merges
                if lower != word:
                    return self.word(lower)
                return np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()
            if lower[-1] in ".," and lower[:-1].isalpha():
                return self.word(lower[:-1]) + self.word(lower[-1])
        if _LATIN.fullmatch(word):
            lower = word.lower()
            if lower != word:
                return self.word(lower)
            return np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))], self.dtype).tobytes()
        if word[-1] in ".," and _LATIN.fullmatch(word[:-1]):
            return self.word(word[:-1].lower()) + self.word(word[-1])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def text(self, text: str) -> bytes:
        words = [w for w in re.split("[ \t\n\r]+", text) if w] if _ODD_SPACE.search(text) else text.split()
        get = self.new.get
        parts = [get(w) for w in words]
        if None in parts:
            parts = [self.word(w) if p is None else p for p, w in zip(parts, words)]
        return b"".join(parts)


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int = 4) -> WordEncoder:
    """The encoder of this worker process."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, width: int = 4) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, doc_tokens, ids (little-endian unsigned numbers of ``width`` bytes)."""
    path = path or tokenizer_path()
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, width)
        doc_ids, ids, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(enc.text(text.as_py() or "") + end)
                held += len(ids[-1])
                if held >= OUT_BYTES:
                    yield _pieces(doc_ids, ids, capacity, width)
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield _pieces(doc_ids, ids, capacity, width)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def _pieces(doc_ids: list[int | None], ids: list[bytes], capacity: int, width: int) -> pa.RecordBatch:
    """The documents' ids end to end in one buffer, which the pieces share."""
    tokens = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    cuts = -(-tokens // capacity)
    of = np.repeat(np.arange(len(ids)), cuts)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
    length = np.minimum(capacity, tokens[of] - start)
    at = np.zeros(len(of) + 1, np.int32)
    np.cumsum(length * width, out=at[1:])
    column = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(at), pa.py_buffer(b"".join(ids))])
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(tokens[of]), column], schema=PIECES)


# ---- patterns, from the histogram alone

def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the dearest multiset of sizes that fits in ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    worth = np.full(room + 1, -np.inf)  # by size, so that both sides of the sum are plain slices
    worth[sizes] = values
    index = np.zeros(room + 1, np.int64)
    index[sizes] = np.arange(len(sizes))
    back = worth[::-1].copy()  # back[room - s] is the worth of size s
    for cap in range(1, room + 1):
        gain = best[:cap] + back[room - cap:room]
        at = int(gain.argmax())
        if gain[at] > best[cap - 1] + 1e-12:
            best[cap], pick[cap] = gain[at], index[cap - at]
        else:
            best[cap] = best[cap - 1]
    counts, cap = np.zeros(len(sizes)), room
    while cap > 0:
        if pick[cap] < 0:
            cap -= 1
        else:
            counts[pick[cap]] += 1
            cap -= sizes[pick[cap]]
    return float(best[room]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse of ``a`` by elimination with row pivots.

    Plain slices only: a threaded matrix routine may never return in a driver
    process that also holds a Spark session.
    """
    n = len(a)
    work = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(work[k:, k]).argmax())
        if top != k:
            work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, refresh: int = REFRESH) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, copies) of patterns that together hold ``demand`` exactly.

    Revised simplex on the covering program; the basis has one column for each
    size, so memory is bounded by the number of classes.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    # a little more demand, different for each size, keeps degenerate steps from cycling
    aim = demand + 1e-3 * np.random.default_rng(0).random(m)
    x = (inverse * aim).sum(axis=1)
    since = 0
    while True:
        duals = inverse.sum(axis=0)
        value, column = best_pattern(np.maximum(duals, 0), sizes, room)
        # x.sum() / value bounds the optimum from below: stop within one sequence or 0.1 % of it
        if x.sum() * (1 - 1 / max(value, 1)) <= max(1.0, 1e-3 * x.sum()):
            break
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        x = np.maximum(x, 0)
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
        since += 1
        if since % refresh == 0:  # rounding errors do not build up
            inverse = inverted(columns)
            x = np.maximum((inverse * aim).sum(axis=1), 0)
    left = demand.astype(np.int64).copy()
    found: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x):
        column = columns[:, k].astype(np.int64)
        used = column > 0
        copies = int(min(np.floor(x[k] + 1e-6), (left[used] // column[used]).min()))
        if copies > 0:
            found.append((column, copies))
            left -= column * copies
    return found + best_fit(sizes, left, room)


def best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing for the pieces that rounding left over."""
    bins: list[tuple[int, np.ndarray]] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fits = [i for i, (free, _) in enumerate(bins) if free >= sizes[k]]
            if fits:
                i = min(fits, key=lambda i: bins[i][0])
                free, held = bins[i]
            else:
                i, free, held = len(bins), room, np.zeros(len(sizes), np.int64)
                bins.append((free, held))
            held[k] += 1
            bins[i] = (free - int(sizes[k]), held)
    merged: dict[bytes, tuple[np.ndarray, int]] = {}
    for _, held in bins:
        merged[held.tobytes()] = (held, merged.get(held.tobytes(), (held, 0))[1] + 1)
    return list(merged.values())


def slot_table(patterns: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per copy, first sequence, first slot) of every class in every pattern."""
    taken, rows, sequence = [0] * len(sizes), [], 0
    for counts, copies in patterns:
        slot = 0
        for k in np.flatnonzero(counts)[::-1]:
            each = int(counts[k])
            rows.append((int(sizes[k]), taken[k], taken[k] + each * copies, each, sequence, slot))
            taken[k] += each * copies
            slot += each
        sequence += copies
    return rows


# ---- assignment, on Spark

def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with doc_id, start and length.

    Sequences are padded to ``capacity``.  Pieces are ranked and placed by narrow
    rows; their other columns move once, to meet their place.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces", {"compression": "zstd"})
    narrow = pieces.select("_row", "length", F.ceil(F.col("length") / grain).cast("int").alias("_class"))
    histogram = sorted((r["_class"], r["count"]) for r in narrow.groupBy("_class").count().collect())  # at most capacity / grain rows
    sizes, demand = np.array([k for k, _ in histogram], np.int64), np.array([n for _, n in histogram], float)
    slots = slot_table(solve_patterns(sizes, demand, capacity // grain), sizes)
    slots_df = spark.createDataFrame(slots, "_class int, _from long, _to long, _each long, _first long, _slot0 long")

    # rank inside the class: buckets of bounded size, each ranked alone
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(64, min(bucket_rows, int(demand.sum()) // (2 * partitions)))
    n_buckets = max(1, -(-int(demand.max(initial=0)) // most))
    dealt = narrow.withColumn("_key", F.xxhash64("_row")).withColumn("_bucket", F.pmod("_key", F.lit(n_buckets)).cast("int"))
    counts = dealt.groupBy("_class", "_bucket").count()
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_bucket").orderBy("_key", "_row")
    ranked = dealt.join(offsets, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)

    # the slot table has at most (classes x classes per pattern) rows
    placed = ranked.join(F.broadcast(slots_df), "_class").where("_rank >= _from and _rank < _to")
    nth = F.col("_rank") - F.col("_from")
    placed = placed.withColumns({"sequence_id": F.col("_first") + F.floor(nth / F.col("_each")), "_slot": F.col("_slot0") + nth % F.col("_each")})
    along = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("_row", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed, "_row").drop("_row")


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids)
