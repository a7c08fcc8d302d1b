"""Choosing markets and trades: filters, splits, windows, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.operators.running import DAY_MS, Track, running
from tapescope.operators.scan import ranged


def filter_notional(tape: DataFrame, min_usd: float) -> DataFrame:
    return tape.where(F.col("notional_usdc") >= min_usd)


def filter_time_window(tape: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Trades inside [start, end], both ends included."""
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("start is after end")
    df = tape if start_ms is None else tape.where(F.col("timestamp_ms") >= start_ms)
    return df if end_ms is None else df.where(F.col("timestamp_ms") <= end_ms)


def cap_at_close(tape: DataFrame, markets: DataFrame, end_ms: int) -> DataFrame:
    """Trades up to the earlier of ``end_ms`` and the market's close."""
    m = markets.select("market_id", F.least(F.lit(end_ms), F.coalesce("close_ms", F.lit(end_ms))).alias("_end"))
    return tape.join(m, "market_id").where("timestamp_ms <= _end").drop("_end")


def markets_by_volume(markets: DataFrame, min_volume: float = 0.0, k: int | None = None) -> DataFrame:
    df = markets.where(F.col("volume") >= min_volume).orderBy(F.desc("volume"), "market_id")
    return df if k is None else df.limit(k)


def search_markets(markets: DataFrame, keywords: DataFrame, text: str, k: int = 20) -> DataFrame:
    """Top ``k`` markets by volume per keyword contained in the text, ignoring case.

    ``status`` tells resolved markets (with a ``close_ms``) from active ones.
    ``keywords`` is the searcher's own short list (column ``keyword``).  The top
    k per keyword is kept as a bounded heap-like aggregate, not a full sort.
    """
    hits = markets.join(F.broadcast(keywords), F.contains(F.lower(text), F.lower("keyword")))
    status = F.when(F.col("close_ms").isNotNull(), "resolved").otherwise("active")
    return top_k(hits, ["keyword"], [F.desc("volume"), F.asc("market_id")], k).withColumn("status", status)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key with ``rank``.  Spark prunes to k rows per key
    and task before the shuffle (window group limit), so hot keys stay small."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_markets(markets: DataFrame, classes: DataFrame | None = None, start_ms: int | None = None, end_ms: int | None = None,
                   min_volume: float = 0.0, include: list[str] | None = None, exclude: list[str] | None = None,
                   plausible: bool | None = None) -> DataFrame:
    """Markets closed in the window with enough volume and a wanted classification."""
    df = markets.where(F.col("close_ms").isNotNull() & (F.coalesce("volume", F.lit(0.0)) >= min_volume))
    if start_ms is not None:
        df = df.where(F.col("close_ms") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("close_ms") <= end_ms)
    if include or exclude or plausible is not None:
        df = df.join(classes, "market_id")
        if plausible is not None:
            df = df.where(F.col("insider_plausible") == plausible)
        if include:
            df = df.where(F.upper("category").isin([c.strip().upper() for c in include]))
        if exclude:
            df = df.where(~F.upper("category").isin([c.strip().upper() for c in exclude]))
    return df


def trade_counts(tape: DataFrame) -> DataFrame:
    return tape.groupBy("market_id").agg(F.count(F.lit(1)).alias("n_trades"))


def with_min_trades(markets: DataFrame, tape: DataFrame, n: int) -> DataFrame:
    counts = markets.join(trade_counts(tape), "market_id", "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0).cast("long")))
    return counts.withColumn("kept", F.col("n_trades") >= n)


def min_trades_stats(flagged: DataFrame) -> DataFrame:
    """Kept, dropped, empty, total, upper median and largest count."""
    n = F.col("n_trades")
    agg = flagged.agg(F.count(F.lit(1)).alias("input_markets"), F.count_if("kept").alias("kept_markets"),
                      F.count_if(~F.col("kept")).alias("dropped_markets"), F.count_if(n == 0).alias("zero_trade_markets"),
                      F.sum("n_trades").alias("total_trades"), F.max("n_trades").alias("max_trades"))
    ranked = ranged(flagged.select("n_trades", "market_id"), [], ["n_trades", "market_id"], [Track("_below", "sum", F.lit(1).cast("long"))])
    mid = ranked.join(agg.select("input_markets"), F.col("_below") == F.floor(F.col("input_markets") / 2)).select(
        F.col("n_trades").cast("double").alias("median_trades"))
    return agg.crossJoin(mid)


def close_rank(markets: DataFrame) -> DataFrame:
    """Position by close time (1 = oldest; no time: last, by id) and the market count."""
    t = markets.withColumn("_t", F.coalesce("close_ms", F.lit(2**61).cast("long")))
    ranked = ranged(t, [], ["_t", "market_id"], [Track("_rank", "sum", F.lit(1).cast("long"))], inclusive=True)
    n = markets.agg(F.count(F.lit(1)).alias("_n"), F.count("close_ms").alias("_timed"))
    return ranked.drop("_t").crossJoin(F.broadcast(n))


def train_val_split(markets: DataFrame, val_fraction: float, min_val: int = 10) -> DataFrame:
    """The newest round(n * f) closed markets are for validation; off when too few."""
    df = close_rank(markets)
    target = F.least(F.bround(F.col("_n") * val_fraction), F.col("_timed"))
    val = (target >= min_val) & F.col("close_ms").isNotNull() & (F.col("_rank") > F.col("_timed") - target)
    return df.withColumn("part", F.when(val, "val").otherwise("train")).drop("_rank", "_n", "_timed")


def split_by_close_time(markets: DataFrame, eval_fraction: float) -> DataFrame:
    df = close_rank(markets)
    k = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * eval_fraction)))
    return df.withColumn("part", F.when(F.col("_rank") > F.col("_n") - k, "eval").otherwise("train")).drop("_rank", "_n", "_timed")


def assign_windows(tape: DataFrame, windows: DataFrame) -> DataFrame:
    """Tag trades with each (train or test) window of the run grid they fall in.

    The grid is a driver-made list of months.
    """
    hit = (F.col("timestamp_ms") >= F.col("start_ms")) & (F.col("timestamp_ms") < F.col("end_ms"))
    return tape.join(F.broadcast(windows), hit)


def plain_wallet(c: Column) -> Column:
    """Address without 0x, lower case: matches either way of writing it."""
    return F.regexp_replace(F.lower(F.trim(c)), "^0x", "")


def boost_bucket(boost: Column, edges: list[float]) -> Column:
    """Index of the width bucket [edge_i, edge_i+1), the last closed; -1 for no boost."""
    out = F.when(boost.isNull() | (boost < edges[0]) | (boost > edges[-1]), -1)
    for i in range(len(edges) - 1):
        last = i == len(edges) - 2
        out = out.when((boost >= edges[i]) & ((boost <= edges[i + 1]) if last else (boost < edges[i + 1])), i)
    return out


def prior_trade_counts(tape: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """Per (market, wallet of the market): the wallet's trades anywhere before the
    market's first trade."""
    first = tape.groupBy("market_id").agg(F.min("timestamp_ms").alias("_first"))
    pairs = tape.groupBy("market_id", "wallet").agg(F.min("seq").alias("seq")).join(first, "market_id")
    asks = pairs.select("market_id", "wallet", F.col("_first").alias("_t"), F.lit(0).alias("_k"), "seq")
    marks = tape.select("wallet", F.col("timestamp_ms").alias("_t"), F.lit(1).alias("_k"), "seq")
    seen = running(asks.unionByName(marks, allowMissingColumns=True), ["wallet"], ["_t", "_k", "seq", "market_id"],
                   [Track("prior_trades", "sum", F.col("_k").cast("long"))], chunk_ms)
    return seen.where("_k = 0").select("market_id", "wallet", "prior_trades")


def asset_outcome_map(markets: DataFrame) -> DataFrame:
    """token id -> (market, outcome index) from the market's token array."""
    return markets.select("market_id", F.posexplode("token_ids").alias("outcome_index", "asset_id"))


def book_asof(tape: DataFrame, books: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """Latest book snapshot of the traded asset at the trade's time.

    Snapshots are numbered first so that only ids move through the as-of pass
    and a snapshot's arrays are fetched once per trade at the end.
    """
    from tapescope.operators.running import asof
    t = tape.withColumn("asset_id", F.col("market_id") * 2 + F.col("outcome_index"))
    hit = asof(t, books.select("asset_id", "timestamp_ms"), ["asset_id"], "timestamp_ms", "timestamp_ms", {"book_ms": "timestamp_ms"}, chunk_ms=chunk_ms)
    b = books.select("asset_id", F.col("timestamp_ms").alias("book_ms"), "bids", "asks")
    return hit.join(b, ["asset_id", "book_ms"], "left")
