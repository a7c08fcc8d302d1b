"""Live feeds with Structured Streaming.

Parsing, cleaning and duplicate removal are ordinary streaming operators.  What
needs market-wide state runs in ``foreachBatch`` on the stored trade table with
the batch operators, so stream and batch cannot drift apart and a hot market is
spread over tasks exactly as in a batch replay.

The feed has an event-time watermark (10 minutes unless given); later rows are
dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.operators import detectors, graph, jumps, scoring
from tapescope.operators.books import wallet_first_seen
from tapescope.operators.running import HOUR_MS
from tapescope.sources.readers import parse_trade_json

WATERMARK = "10 minutes"


def trade_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """JSON trade records arriving as text files; rows that do not parse are dropped."""
    reader = spark.readStream.schema("value string").format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_trade_json(reader.load(folder))


def dedup(trades: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per (tx_hash, asset); the state is dropped as the watermark passes."""
    timed = trades.withColumn("ts", F.timestamp_millis("timestamp_ms"))
    return timed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["tx_hash", "asset"])


def tumbling_volume(trades: DataFrame, watermark: str = WATERMARK, width: str = "300 seconds") -> DataFrame:
    """Count and notional per (market, outcome, side) in fixed windows."""
    timed = trades if "ts" in trades.columns else trades.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", width).alias("w"), "condition_id", "outcome_index", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("notional_usdc").alias("volume"))


def as_tape(trades: DataFrame) -> DataFrame:
    """Stream columns to tape columns.

    Ids that are numbers stay numbers; other condition ids (0x..) get a 64-bit
    key and keep their text in ``condition_id``.  Ties in time are broken by a
    numbered transaction's number, else by a hash of transaction and asset.
    """
    number = F.regexp_extract("tx_hash", "^[A-Za-z]*([0-9]{1,18})$", 1).try_cast("long")
    return trades.select(
        F.coalesce(number, F.xxhash64("tx_hash", "asset")).alias("seq"), "timestamp_ms", "wallet",
        F.coalesce(F.col("condition_id").try_cast("long"), F.xxhash64("condition_id")).alias("market_id"), "condition_id", "outcome_index", "side", "price",
        "notional_usdc", "size_tokens", "tx_hash")


class TradeStore:
    """Folder of Parquet tables that the stream appends to, one folder per batch.

    A batch rewrites only its own folder, so a batch that is run again after a
    failure replaces what it wrote before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, table: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def get(self, table: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}/*")


def on_batch(store: TradeStore, cfg: dict, rescore: bool = False, recluster: bool = False) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: store trades, score the new ones, write alerts and stat deltas.

    New trades see all earlier stored trades of their markets, as in a replay.
    Statistics are written as deltas per batch and summed when read, so no
    stored row is ever updated in place.
    """

    def handle(batch: DataFrame, number: int) -> None:
        store.put("trades", as_tape(batch), number)
        tape = store.get("trades").drop("batch")
        new = store.spark.read.parquet(f"{store.folder}/trades/batch={number}")
        touched = new.select("market_id").distinct()
        scored = scoring.replay(tape.join(touched, "market_id", "left_semi"), cfg)
        fresh = scored.join(new.select("market_id", "seq"), ["market_id", "seq"], "left_semi")
        store.put("scores", fresh.select("market_id", "seq", "wallet", "timestamp_ms", "side", "outcome_index", "notional_usdc", "tx_hash",
                                         "total_score", "is_alert"), number)
        done = store.spark.read.parquet(f"{store.folder}/scores/batch={number}")
        store.put("stats", stat_deltas(done), number)
        first = tape.join(new.select("wallet").distinct(), "wallet", "left_semi")
        aged = new.join(wallet_first_seen(first), "wallet", "left")
        store.put("new_wallets", aged.withColumn("confidence", detectors.new_wallet(cfg)).where("confidence > 0").select("seq", "wallet", "confidence"), number)
        if rescore:
            newest = tape.agg(F.max("timestamp_ms").alias("_now"))
            buffer = tape.crossJoin(F.broadcast(newest)).where(F.col("timestamp_ms") >= F.col("_now") - int(cfg["jumps"]["buffer_hours"] * HOUR_MS)).drop("_now")
            store.put("jump_boosts", jumps.score_jump_wallets(buffer, jumps.find_jumps(buffer, cfg), cfg), number)
        if recluster:
            member, meta = graph.clusters(graph.large_trades(tape, cfg), cfg)
            store.put("clusters", graph.wallet_boosts(member, meta), number)

    return handle


def stat_deltas(scored: DataFrame) -> DataFrame:
    buy = F.when(F.col("side") == "BUY", F.col("notional_usdc")).otherwise(0.0)
    return scored.groupBy("wallet", "market_id").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(buy).alias("buy_notional"), F.sum(F.col("notional_usdc") - buy).alias("sell_notional"),
        F.count_if("is_alert").alias("flag_count"), F.min("timestamp_ms").alias("first_trade_ts"), F.max("timestamp_ms").alias("last_trade_ts"))


def wallet_stats(store: TradeStore) -> DataFrame:
    """Current statistics: the sum of all deltas."""
    return store.get("stats").groupBy("wallet", "market_id").agg(
        *[F.sum(c).alias(c) for c in ("trade_count", "buy_notional", "sell_notional", "flag_count")],
        F.min("first_trade_ts").alias("first_trade_ts"), F.max("last_trade_ts").alias("last_trade_ts"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived and stop."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
