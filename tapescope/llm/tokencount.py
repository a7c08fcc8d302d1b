"""Edit-aware token counts: segment trees over the pre-tokens of each document.

``build`` splits a text into pre-tokens, counts the tokens of each and keeps them
in leaves under a tree of sums.  ``edited`` applies edits to a document: the tree
finds the pre-token just before the edit, the text is split anew from there until
a boundary falls on an old one behind the edit, only those pre-tokens are encoded
and only the sums above the touched leaves change.  That is exact because the
split looks at most two characters past a pre-token and never back.

Both steps are narrow; a task holds one batch of documents.

Defined cases: null and empty texts have no tokens; an edit is a position, a
number of characters to delete and a text to insert, applied in order to the text
the edits before left; positions and lengths beyond the text are clipped; null
fields count as 0 or empty; repeated documents are counted each; an empty table
gives no rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapescope.llm.common import map_batches

LEAF, CACHE_PIECES = 64, 250_000
#: Characters before an edit whose pre-token may change: the split looks this far ahead.
LOOKAHEAD = 2


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Splits texts and counts tokens of pre-tokens, remembering a bounded number of them."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            got = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE_PIECES:
                self.known = {}
            self.known[piece] = got
        return got

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens of ``text``."""
        pieces = self.pattern.findall(text)
        get, tokens = self.known.get, self.tokens
        return list(map(len, pieces)), [get(p) or tokens(p) for p in pieces]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class Tree:
    """Pre-tokens (length, tokens) in leaves; ``chars`` and ``tokens`` hold the sums of node i and its two children 2i, 2i + 1."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.reencoded = 0
        self._fill(list(zip(lengths, counts)))

    def _fill(self, pieces: list[tuple[int, int]]) -> None:
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(n for n, _ in leaf), sum(t for _, t in leaf)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, start) of the pre-token that holds character ``at``, which is in the text."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        leaf = i - self.width
        for k, (n, _) in enumerate(self.leaves[leaf]):
            if at < start + n:
                return leaf, k, start
            start += n
        raise IndexError(at)

    def update(self, leaf: int) -> None:
        """Sums above a leaf."""
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(n for n, _ in self.leaves[leaf]), sum(t for _, t in self.leaves[leaf])
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, text: str, at: int, delete: int, insert: str, count: Counter) -> str:
        """The edited text; the tree follows."""
        at = min(max(at, 0), len(text))
        stop = min(at + max(delete, 0), len(text))
        new = text[:at] + insert + text[stop:]
        if not text:
            self._fill(list(zip(*count.split(new))))
            self.reencoded += sum(map(len, self.leaves))
            return new
        leaf, k, start = self.find(max(0, min(at - LOOKAHEAD, len(text) - 1)))
        shift, pieces = len(new) - len(text), []
        last, j, old = leaf, k, start  # old: boundary of the old split at or behind the new one
        here, end = start, at + len(insert)
        while True:
            if here >= end:
                while old < here - shift:  # the next old boundary
                    while j == len(self.leaves[last]):
                        last, j = last + 1, 0
                    old += self.leaves[last][j][0]
                    j += 1
                if old == here - shift:
                    break
            found = count.pattern.match(new, here)
            pieces.append((found.end() - here, count.tokens(found.group())))
            here = found.end()
        self.reencoded += len(pieces)
        rest = self.leaves[last][j:]
        self.leaves[leaf] = self.leaves[leaf][:k] + pieces + (rest if last == leaf else [])
        if last != leaf:
            self.leaves[last] = rest
        for i in range(leaf + 1, last):
            self.leaves[i] = []
        if len(self.leaves[leaf]) > 8 * LEAF:  # leaves are cut anew, nothing is encoded again
            self._fill([p for x in self.leaves for p in x])
        else:
            for i in range(leaf, last + 1):
                self.update(i)
        return new


def _packed(values: list[int]) -> bytes:
    return np.array(values, "<i4").tobytes()


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, lengths and counts of the pre-tokens (little-endian 32 bit), n_pretokens, n_tokens."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        split = [count.split(t.as_py() or "") for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([_packed(n) for n, _ in split], pa.binary()), pa.array([_packed(t) for _, t in split], pa.binary()),
            pa.array([len(n) for n, _ in split], pa.int64()), pa.array([sum(t) for _, t in split], pa.int64())],
            names=["doc_id", "text", "lengths", "counts", "n_pretokens", "n_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                       "doc_id long, text string, lengths binary, counts binary, n_pretokens long, n_tokens long")


def edited(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Apply ``edits`` (array of structs at, delete, insert) to the rows of ``build``.

    Gives doc_id, n_pretokens, n_tokens, the edited text, its lengths and counts,
    n_tokens_after and n_reencoded, the pre-tokens that were encoded for it.
    """
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        texts, lengths, counts, after, again = [], [], [], [], []
        for text, n, t, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 6))):
            tree, text = Tree(np.frombuffer(n, "<i4").tolist(), np.frombuffer(t, "<i4").tolist()), text or ""
            for e in edits or ():
                if e is not None:
                    text = tree.edit(text, e["at"] or 0, e["delete"] or 0, e["insert"] or "", count)
            pieces = [p for leaf in tree.leaves for p in leaf]
            texts.append(text)
            lengths.append(_packed([p[0] for p in pieces]))
            counts.append(_packed([p[1] for p in pieces]))
            after.append(tree.tokens[1])
            again.append(tree.reencoded)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), pa.array(texts, pa.string()), pa.array(lengths, pa.binary()),
                                           pa.array(counts, pa.binary()), pa.array(after, pa.int64()), pa.array(again, pa.int64())],
                                          names=["doc_id", "n_pretokens", "n_tokens", "text", "lengths", "counts", "n_tokens_after", "n_reencoded"])

    return map_batches(trees.select("doc_id", "text", "lengths", "counts", "n_pretokens", "n_tokens", "edits"), run,
                       "doc_id long, n_pretokens long, n_tokens long, text string, lengths binary, counts binary, n_tokens_after long, n_reencoded long")
