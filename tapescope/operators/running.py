"""Running state per key that no hot key can pin to one task.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole market (or
wallet) into one task.  Here each key is cut into time chunks:

1. ``totals``  one row per (key, chunk), a hash aggregate with map-side combine;
2. ``carry``   what all earlier chunks of the key contribute, a window over the
   totals only (rows per key = chunks in its life, not trades);
3. ``local``   a window inside (key, chunk), which is where the tape is shuffled.

The tape is shuffled once, by (key, chunk); the carry joins on that same
partitioning.  ``chunk_ms`` bounds what a task sorts and is a tuning knob only:
results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Track:
    """One running quantity: ``kind`` is sum, last, max or min of ``value``."""

    name: str
    kind: str
    value: Column


def _over(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "max":
        return F.max(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    raise ValueError(f"unknown track kind {kind!r}")


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], tracks: Sequence[Track],
            chunk_ms: int = DAY_MS, inclusive: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Add one column per track: its value over the key's earlier rows.

    ``order`` must be a total order inside a key and start with a time in ms.
    With ``inclusive`` the current row counts too.  ``source`` is where the
    totals are read from: it holds the rows that contribute to the tracks and at
    least one row in every (key, chunk) of ``df``.  Naming the raw table there keeps a chain of ``running`` calls linear; by
    default the totals recompute ``df``.
    """
    keys, order = list(keys), list(order)
    part = [*keys, "_chunk"]
    values = {t.name: f"_v_{t.name}" for t in tracks}

    def prepared(frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            "_chunk": F.floor(F.col(order[0]) / F.lit(chunk_ms)),
            **{values[t.name]: t.value for t in tracks},
        })

    rows = prepared(df)
    totals = prepared(df if source is None else source).groupBy(*part).agg(
        *[_total(t.kind, F.col(values[t.name]), order).alias(f"_t_{t.name}") for t in tracks])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part, *[_over(t.kind, F.col(f"_t_{t.name}"), before).alias(f"_c_{t.name}") for t in tracks])
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(carry, part, "inner" if source is None else "left")
    out = joined.select("*", *[_over(t.kind, F.col(values[t.name]), within).alias(f"_l_{t.name}") for t in tracks])
    out = out.select("*", *[
        _combine(t.kind, F.col(f"_l_{t.name}"), F.col(f"_c_{t.name}")).alias(t.name) for t in tracks])
    return out.drop("_chunk", *values.values(), *[f"{p}{t.name}" for t in tracks for p in ("_l_", "_c_")])


def row_blocks(numbered: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Cut keys into blocks of ``block_rows`` rows, each led by ``halo`` rows.

    ``numbered`` carries the 1-based position ``_rn`` of a row in its key.  Adds
    ``_block`` and ``_own``; rows with ``_own = false`` are the copies that give
    a block its look-back.  A window over (key, _block) therefore never holds
    more than ``block_rows + halo`` rows, whatever the skew.
    """
    home = F.floor((F.col("_rn") - 1) / F.lit(block_rows))
    slot = (F.col("_rn") - 1) % F.lit(block_rows)
    ahead = F.when(slot >= block_rows - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return (numbered.withColumn("_home", home).withColumn("_block", F.explode(ahead))
            .withColumn("_own", F.col("_block") == F.col("_home")).drop("_home"))


def departures(source: DataFrame, keys: Sequence[str], order: Sequence[str], tracks: Sequence[Track],
               window_ms: int) -> DataFrame:
    """Every row again, at the moment it leaves a trailing window of ``window_ms``."""
    ts, *rest = order
    return source.select(*keys, *rest, *[t.value.alias(f"_x_{t.name}") for t in tracks],
                         (F.col(ts) + F.lit(window_ms + 1)).alias("_t"), F.lit(0).alias("_live"))


def departed_sums(df: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str],
                  tracks: Sequence[Track], at: str, window_ms: int, chunk_ms: int = DAY_MS) -> DataFrame:
    """Per row: sums over the ``source`` rows older than ``window_ms`` at time ``at``.

    ``at`` must be the time of some row of ``source`` with the same key (or null,
    which gives null).  Together with running sums this gives
    trailing-window sums in linear work, without RANGE frames.
    """
    ts, *rest = order
    live = df.withColumns({"_t": F.coalesce(F.col(at), F.lit(-1)), "_live": F.lit(1)})
    gone = departures(source, keys, order, tracks, window_ms)
    both = live.unionByName(gone, allowMissingColumns=True)
    named = [Track(t.name, "sum", F.col(f"_x_{t.name}")) for t in tracks]
    marks = source.select(*keys, *rest, F.col(ts).alias("_t"), F.lit(1).alias("_live")).unionByName(
        gone, allowMissingColumns=True)
    summed = running(both, keys, ["_t", "_live", *rest], named, chunk_ms, source=marks)
    return (summed.where("_live = 1").drop("_t", "_live", *[f"_x_{t.name}" for t in tracks])
            .withColumns({t.name: F.when(F.col(at).isNotNull(), F.col(t.name)) for t in tracks}))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
         values: dict[str, str], right_order: Sequence[str] = (), strict: bool = False,
         chunk_ms: int = DAY_MS, left_source: DataFrame | None = None) -> DataFrame:
    """Latest ``right`` row per key at or before each ``left`` row.

    ``values`` maps new column names to columns of ``right``.  Rows of both
    sides are merged into one event order, so nothing is multiplied and the
    hot-key rules of :func:`running` apply.  ``strict`` looks only at earlier
    times.  ``left`` must carry a unique ``seq``.  ``left_source`` is a cheaper
    frame with the same keys and times, read for the chunk totals.
    """
    rank = 0 if strict else 2
    marks = {"_t": F.col(left_time).cast("long"), "_side": F.lit(rank),
             "_o": F.lit(None).cast("struct<a:long,b:long>")}
    lrows = left.withColumns(marks)
    lmarks = (left if left_source is None else left_source).withColumns(marks).select(*keys, *marks, "seq")
    tie = list(right_order)
    cols = [F.col(c).cast("long") for c in tie] + [F.lit(0).cast("long")] * (2 - len(tie))
    payload = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    rrows = right.select(*keys, F.col(right_time).cast("long").alias("_t"), F.lit(1).alias("_side"),
                         F.struct(cols[0].alias("a"), cols[1].alias("b")).alias("_o"), payload.alias("_payload"))
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    seen = running(both, keys, ["_t", "_side", "_o", "seq"], [Track("_hit", "last", F.col("_payload"))], chunk_ms,
                   source=lmarks.unionByName(rrows, allowMissingColumns=True))
    return seen.where(F.col("_side") == rank).select(
        "*", *[F.col(f"_hit.{new}").alias(new) for new in values]).drop("_t", "_side", "_o", "_payload", "_hit")
