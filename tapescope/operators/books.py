"""Order-book state from snapshot and price-change messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapescope.operators.running import DAY_MS, Track, running


def book_states(messages: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """The book of the asset after every message.

    A snapshot replaces the book; a price change only replaces the price of the
    best levels (size kept, 0 when the side was empty).  So a book is its last
    snapshot plus the last change after it, and both come from running state.
    Columns: asset_id, timestamp_ms, seq, kind, bids, asks, best_bid, best_ask.
    """
    order = F.struct("timestamp_ms", "seq")
    snap, change = F.col("kind") == "snapshot", F.col("kind") == "change"
    seen = running(messages, ["asset_id"], ["timestamp_ms", "seq"], [
        Track("_snap", "last", F.when(snap, F.struct(order.alias("o"), "bids", "asks"))),
        Track("_change", "last", F.when(change & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull(),
                                        F.struct(order.alias("o"), "best_bid", "best_ask")))], chunk_ms, inclusive=True)
    live = F.col("_change").isNotNull() & (F.col("_snap").isNull() | (F.col("_change.o") > F.col("_snap.o")))

    def side(levels: str, best: str):
        old = F.coalesce(F.col(f"_snap.{levels}"), F.array().cast("array<struct<price:double,size:double>>"))
        top = F.struct(F.col(f"_change.{best}").cast("double").alias("price"),
                       F.coalesce(F.get(old, F.lit(0))["size"], F.lit(0.0)).alias("size"))
        return F.when(live, F.concat(F.array(top), F.slice(old, 2, F.greatest(F.size(old), F.lit(1))))).otherwise(old)

    return seen.select("asset_id", "timestamp_ms", "seq", "kind", side("bids", "best_bid").alias("bids"), side("asks", "best_ask").alias("asks"))


def wallet_first_seen(history: DataFrame) -> DataFrame:
    return history.groupBy("wallet").agg(F.min("timestamp_ms").alias("wallet_first_ts"))
