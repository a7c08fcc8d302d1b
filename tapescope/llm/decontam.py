"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items.  Windows of one length share a
table: the last two words of the current text position are looked up in a shift
table that says how far the position may move without missing a window; where
the shift is 0 the words select a bucket of windows (its suffix block), the
first two words a part of it, and those are compared word by word.

Documents are scanned in place, whole and without a shuffle.  The benchmark is
sent to the tasks in blocks of bounded size; with more than one block the
documents pass through one scan per block, whose hits are merged.

Defined cases: null or empty text has no words and no hits; an item without
words has no windows; an item without id marks words but is not listed; items
that repeat an id count once; repeated documents each get their own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapescope.llm.common import map_batches, written

#: Benchmark bytes in one block that tasks hold.
BLOCK_BYTES = 32 << 20

#: Bytes that end a word become a space, A-Z become a-z; UTF-8 bytes from 0x80 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_STATE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ("items", pa.list_(pa.string())), ("text", pa.string())])


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Patterns:
    """Windows of equal length with their shift table and buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], set[str]]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = b" ".join(window[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.skip), length - end)
            suffix, prefix = b" ".join(window[-self.block:]), b" ".join(window[:self.block])
            self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((list(window), items))

    def search(self, words: list[bytes]):
        """(start, end, items) of every occurrence, by end."""
        m, n, skip, get = self.length, len(words), self.skip, self.shift.get
        pair = self.block == 2
        i = m - 1
        while i < n:
            key = words[i - 1] + b" " + words[i] if pair else words[i]
            shift = get(key, skip)
            if shift:
                i += shift
                continue
            first = i - m + 1
            for window, items in self.buckets[key].get(words[first] + b" " + words[first + 1] if pair else words[first], ()):
                if window == words[first:i + 1]:
                    yield first, i + 1, items
            i += 1


def compile_patterns(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    """One table for each window length among the items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            owners = by_length.setdefault(length, {}).setdefault(tuple(words[i:i + length]), set())
            if item_id is not None:
                owners.add(item_id)
    return [Patterns(length, windows) for length, windows in sorted(by_length.items())]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as disjoint spans that do not touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scanner(block, window: int, last: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    tables: list[list[Patterns]] = []

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            tables.append(compile_patterns(block.value, window))
        got = batch.to_pydict()
        counts, hits, listed = [], [], []
        for text, old_hits, old_items in zip(got["text"], got["hits"], got["items"]):
            words = words_of(text)
            spans, owners = [(h["start"], h["end"]) for h in old_hits], set(old_items)
            for patterns in tables[0]:
                for start, end, found in patterns.search(words):
                    if spans and spans[-1][0] <= start <= spans[-1][1] <= end:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
                    owners |= found
            counts.append(len(words))
            hits.append([{"start": s, "end": e} for s, e in merge(spans)])
            listed.append(sorted(owners))
        cols = {"doc_id": got["doc_id"], "n_words": counts, "hits": hits, "items": listed, "text": got["text"]}
        names = _STATE.names[:-1] if last else _STATE.names
        return pa.RecordBatch.from_arrays([pa.array(cols[n], _STATE.field(n).type) for n in names], schema=pa.schema([_STATE.field(n) for n in names]))

    return scan


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """The benchmark in blocks of about ``block_bytes``, dealt by hash: broadcasts, made and held one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    for k in range(n):
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: number of words, spans of words inside benchmark windows, ids of the items they come from.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are not looked at.  A benchmark of several blocks is searched block by block,
    and what was found is written between them.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"),
                      F.col("text").cast("string").alias("text"))
    held = None
    for block in item_blocks(benchmark, block_bytes):
        if held is not None:
            out = written(map_batches(out, _scanner(held, window, False), SCHEMA + ", text string"), "hits")
            held.unpersist()
        held = block
    return map_batches(out, _scanner(held, window, True), SCHEMA)


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose ``text`` holds no window of an item; block by block, as above."""
    held = None
    for block in item_blocks(benchmark, block_bytes):
        if held is not None:
            docs = written(docs.where(~_holds(held, window)(F.col("text").cast("string"))), "clean")
            held.unpersist()
        held = block
    return docs.where(~_holds(held, window)(F.col("text").cast("string")))


def _holds(block, window: int):
    tables: list[list[Patterns]] = []

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        if not tables:
            tables.append(compile_patterns(block.value, window))
        return pd.Series([any(next(p.search(words), None) is not None for p in tables[0]) for words in map(words_of, texts)], dtype=bool)

    return holds
