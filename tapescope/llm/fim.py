"""Fill-in-middle documents cut through a learned rank index.

A text is a row of units, ``[A-Za-z]+|[^A-Za-z]``.  Its boundaries (where unit r
begins, in code points) grow nearly linearly with r, so a few straight segments
predict all of them within ``ERROR`` code points; one signed byte a boundary
holds what a prediction misses, and a cut after r units is found by one
prediction and one correction, exactly.  Two hashes of the document's id choose
the cuts, two more the form: plain, or prefix, suffix and middle in one of two
orders behind the marks ``<P>``, ``<S>`` and ``<M>``.

Defined cases: null or empty text has no units and stays plain; so does a text
that holds a mark; a null doc_id hashes as the empty text; rows that repeat a
doc_id are transformed each; a text of one unit is cut before or after it; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a segment's prediction may lie from a boundary; what a signed byte holds.
ERROR = 127
#: Boundaries of the first try of a segment.
FIRST_SPAN = 2048


def boundaries(text: str) -> np.ndarray:
    """Where each unit begins, in code points, and the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) - 97) < 26
    return np.concatenate([[0], np.flatnonzero(~(letter[1:] & letter[:-1])) + 1, [len(points)]]) if len(points) else np.zeros(1, np.int64)


@dataclass
class RankIndex:
    """Segments (first rank, intercept, slope) and what they miss at every rank."""

    first: np.ndarray
    intercept: np.ndarray
    slope: np.ndarray
    residuals: np.ndarray

    def __len__(self) -> int:
        return len(self.residuals) - 1

    def predicted(self, rank: int) -> int:
        k = int(np.searchsorted(self.first, rank, side="right")) - 1
        return int(_line(float(self.intercept[k]), float(self.slope[k]), rank - int(self.first[k])))

    def cut(self, rank: int) -> int:
        """The exact offset of boundary ``rank``."""
        return self.predicted(rank) + int(self.residuals[rank])


def _line(intercept: float, slope: float, steps):
    return np.floor(intercept + slope * steps + 0.5).astype(np.int64)


def _segment(offsets: np.ndarray) -> tuple[float, float, np.ndarray]:
    """A line through the ends, moved to the middle of what it misses."""
    steps = np.arange(len(offsets))
    slope = (offsets[-1] - offsets[0]) / max(len(offsets) - 1, 1)
    missed = offsets - slope * steps
    intercept = float(missed.max() + missed.min()) / 2
    return intercept, float(slope), offsets - _line(intercept, slope, steps)


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Greedy segments: each is stretched by doubling, then halving steps, while no boundary is missed by more than ``error``."""
    parts, residuals, start = [], [], 0
    while start < len(offsets):
        best, step = (1, _segment(offsets[start:start + 1])), FIRST_SPAN
        while step:
            size = min(best[0] + step, len(offsets) - start)
            tried = _segment(offsets[start:start + size])
            if size > best[0] and np.abs(tried[2]).max() <= error:
                best = size, tried
                step = 0 if start + size == len(offsets) else step * 2
            else:
                break
        while step > 1:
            step //= 2
            size = min(best[0] + step, len(offsets) - start)
            tried = _segment(offsets[start:start + size])
            if np.abs(tried[2]).max() <= error:
                best = size, tried
        size, (intercept, slope, missed) = best
        parts.append((start, intercept, slope))
        residuals.append(missed)
        start += size
    first, intercept, slope = zip(*parts)
    return RankIndex(np.array(first), np.array(intercept), np.array(slope), np.concatenate(residuals).astype(np.int8 if error < 128 else np.int64))


def transform(text: str, numbers: tuple[int, int, int, int], fim_percent: int = 90, spm_percent: int = 20) -> tuple[int, str, tuple[int, int] | None, int]:
    """(units, form, cuts in code points or None, segments of the index) of a text whose document drew ``numbers``."""
    index = fit(boundaries(text))
    n, (h1, h2, h3, h4) = len(index), numbers
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, len(index.first)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_percent else "psm", (index.cut(low), index.cut(high)), len(index.first)


def drawn(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))


# ---- Spark

def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain), n_segments, output for every row of ``docs`` (doc_id, text)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            n, form, cuts, segments = transform(text, drawn(doc_id, seed), fim_percent, spm_percent)
            if cuts is None:
                rows.append((n, form, None, None, segments, text))
                continue
            a, b = cuts
            parts = {"P": PREFIX + text[:a], "S": SUFFIX + text[b:], "M": MIDDLE + text[a:b]}
            rows.append((n, form, a, b - a, segments, "".join(parts[k] for k in ("PSM" if form == "psm" else "SPM"))))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_segments", "output"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                       "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_segments long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output came from: a mark of its own stands first in its part, and no text with marks is cut."""
    head = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    psm = F.concat(head(after(output, PREFIX), SUFFIX), after(output, MIDDLE), head(after(output, SUFFIX), MIDDLE))
    spm = F.concat(head(after(output, PREFIX), MIDDLE), after(output, MIDDLE), head(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
