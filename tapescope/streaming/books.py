"""Order books kept up to date by a stream, and looked up by the trades in it.

Messages come as JSON text: a list of snapshots, or an event with price changes.
Each asset has one keyed state, its book.  A snapshot replaces the book; a change
replaces the price of the best level of both sides (the size stays, 0 on an empty
side).  Trades of the asset pass through the same state and leave with the book
as of their time.

Messages at most ``delay`` behind the newest one of their asset still take their
place in the order of time, for trades that come later; older ones, and repeats,
change nothing.  A book without messages for ``idle`` is forgotten.  At equal
times a snapshot comes before a change, and messages before trades.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEVEL = "struct<price:string,size:string>"
SNAPSHOT = f"array<struct<asset_id:string,timestamp:string,bids:array<{LEVEL}>,asks:array<{LEVEL}>>>"
EVENT = "event_type string, timestamp string, price_changes array<struct<asset_id:string,best_bid:string,best_ask:string>>"
LEVELS = "array<struct<price:double,size:double>>"
_RANK = {"snapshot": 0, "change": 1, "trade": 2}


def parse_book_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """asset_id, timestamp_ms, kind, bids, asks, best_bid, best_ask; text that is neither is dropped.

    Levels need a positive price and size; a change needs both prices, which are not 0.
    """
    def levels(side: str):
        numbers = F.transform(side, lambda lv: F.struct(lv["price"].try_cast("double").alias("price"), lv["size"].try_cast("double").alias("size")))
        return F.filter(numbers, lambda lv: (lv["price"] > 0) & (lv["size"] > 0))

    snaps = raw.where(F.col(column).startswith("[")).select(F.explode(F.from_json(column, SNAPSHOT)).alias("m")).select("m.*")
    none = F.lit(None).cast("double")
    snaps = snaps.select("asset_id", F.col("timestamp").try_cast("long").alias("timestamp_ms"), F.lit("snapshot").alias("kind"),
                         F.sort_array(levels("bids"), asc=False).alias("bids"), F.sort_array(levels("asks")).alias("asks"), none.alias("best_bid"), none.alias("best_ask"))
    events = raw.where(F.col(column).startswith("{")).select(F.from_json(column, EVENT).alias("e")).where("e.event_type = 'price_change'")
    changes = events.select(F.col("e.timestamp").try_cast("long").alias("timestamp_ms"), F.explode("e.price_changes").alias("c"))
    empty = F.lit(None).cast(LEVELS)
    changes = changes.select("c.asset_id", "timestamp_ms", F.lit("change").alias("kind"), empty.alias("bids"), empty.alias("asks"),
                             F.col("c.best_bid").try_cast("double").alias("best_bid"), F.col("c.best_ask").try_cast("double").alias("best_ask"))
    changes = changes.where("best_bid <> 0 and best_ask <> 0")
    return snaps.unionByName(changes).where("asset_id <> '' and timestamp_ms is not null")


def applied(book: dict | None, message: dict) -> dict:
    """The book after a message; sides are lists of (price, size), best first."""
    if message["kind"] == "snapshot":
        return {"book_ms": message["t"], "bids": message["bids"], "asks": message["asks"]}
    book = book or {"book_ms": None, "bids": [], "asks": []}
    top = lambda side, price: [[price, side[0][1] if side else 0.0], *side[1:]]
    return {"book_ms": book["book_ms"], "bids": top(book["bids"], message["bid"]), "asks": top(book["asks"], message["ask"])}


class Book:
    """One asset's book: what is settled, and the messages that may still be overtaken by late ones."""

    def __init__(self, text: str | None, delay_ms: int):
        held = json.loads(text) if text else {"book": None, "settled": None, "recent": []}
        self.book, self.settled, self.recent, self.delay_ms = held["book"], held["settled"], held["recent"], delay_ms

    def to_json(self) -> str:
        return json.dumps({"book": self.book, "settled": self.settled, "recent": self.recent}, sort_keys=True)

    @property
    def newest(self) -> int | None:
        return self.recent[-1]["t"] if self.recent else self.settled

    def take(self, messages: list[dict]) -> None:
        """Put new messages into their places, once each, and settle what no late message can overtake."""
        fresh = [m for m in messages if self.settled is None or m["t"] > self.settled]
        if not fresh:
            return
        known = {json.dumps(m, sort_keys=True): m for m in [*self.recent, *fresh]}
        self.recent = sorted(known.values(), key=lambda m: (m["t"], _RANK[m["kind"]], m.get("bid") or 0.0, m.get("ask") or 0.0, json.dumps(m, sort_keys=True)))

    def as_of(self, times: list[int]) -> Iterator[dict | None]:
        """The book at each of the rising ``times``."""
        book, k = self.book, 0
        for t in times:
            while k < len(self.recent) and self.recent[k]["t"] <= t:
                book, k = applied(book, self.recent[k]), k + 1
            yield book

    def settle(self) -> None:
        if self.recent:
            limit, k = self.newest - self.delay_ms, 0
            while k < len(self.recent) and self.recent[k]["t"] < limit:
                self.book, self.settled = applied(self.book, self.recent[k]), self.recent[k]["t"]
                k += 1
            self.recent = self.recent[k:]


_OUT = "asset_id string, seq long, timestamp_ms long, book_ms long, bids string, asks string"


def book_lookup(messages: DataFrame, trades: DataFrame, delay: str = "10 minutes", delay_ms: int = 600_000, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Trades (asset_id, seq, timestamp_ms) with the book of their asset as of their time: book_ms (its snapshot's time), bids, asks.

    ``messages`` come from :func:`parse_book_messages`, both frames from streams.
    Trades of an asset without a book leave with nulls.
    """
    pairs = lambda side: F.to_json(F.transform(side, lambda lv: F.array(lv["price"], lv["size"])))
    rows = messages.select("asset_id", "timestamp_ms", "kind", pairs("bids").alias("bids"), pairs("asks").alias("asks"), "best_bid", "best_ask", F.lit(None).cast("long").alias("seq"))
    asks = trades.select(F.col("asset_id").cast("string").alias("asset_id"), "timestamp_ms", F.lit("trade").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("bids", "asks")],
                         *[F.lit(None).cast("double").alias(c) for c in ("best_bid", "best_ask")], "seq")
    timed = rows.unionByName(asks).withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        book = Book(state.get[0] if state.exists else None, delay_ms)
        messages, asked = [], []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.kind == "trade":
                    asked.append((int(r.timestamp_ms), int(r.seq)))
                elif r.kind == "snapshot":
                    messages.append({"t": int(r.timestamp_ms), "kind": "snapshot", "bids": json.loads(r.bids), "asks": json.loads(r.asks)})
                else:
                    messages.append({"t": int(r.timestamp_ms), "kind": "change", "bid": float(r.best_bid), "ask": float(r.best_ask)})
        book.take(messages)
        asked.sort()
        out = [(key[0], seq, t, *((b["book_ms"], json.dumps(b["bids"]), json.dumps(b["asks"])) if b else (None, None, None)))
               for (t, seq), b in zip(asked, book.as_of([t for t, _ in asked]))]
        book.settle()
        if book.newest is not None:
            state.update((book.to_json(),))
            state.setTimeoutTimestamp(max(book.newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=["asset_id", "seq", "timestamp_ms", "book_ms", "bids", "asks"])
            yield frame.astype({"seq": "int64", "timestamp_ms": "int64", "book_ms": "Int64"})

    found = timed.groupBy("asset_id").applyInPandasWithState(update, _OUT, "book string", "append", GroupStateTimeout.EventTimeTimeout)
    levels = lambda side: F.transform(F.from_json(side, "array<array<double>>"), lambda lv: F.struct(lv[0].alias("price"), lv[1].alias("size")))
    return found.withColumns({"bids": levels("bids"), "asks": levels("asks")})
