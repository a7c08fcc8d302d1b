"""Sinks: layouts, upserts and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.operators.state import ORDER, is_buy, signed_tokens
from tapescope.sources.readers import first_per_key


def convert_layout(fills: DataFrame, path: str, files_per_market: int = 16) -> None:
    """Partition by market, sort by time inside files so min/max pruning works.

    The spread column keeps a hot market from landing in one file writer.
    """
    spread = F.pmod(F.xxhash64("seq"), F.lit(files_per_market))
    (fills.withColumn("_spread", spread).repartition("market_id", "_spread").drop("_spread")
     .sortWithinPartitions("market_id", "timestamp").write.mode("overwrite").partitionBy("market_id").parquet(path))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Flat alert rows: signals as text, one row per transaction (first wins)."""
    text = F.concat_ws(" | ", F.transform("signals", lambda s: F.concat(
        s["detector"], F.lit("("), F.format_number(s["confidence"], 2), F.lit(")"))))
    flat = alerts.select("tx_hash", "seq", "market_id", "wallet", "timestamp_ms", "side", "outcome_index", "price", "notional_usdc",
                         "total_score", text.alias("signals"))
    return first_per_key(flat, ["tx_hash"], ORDER)


def wallet_market_stats(tape: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per (wallet, market): trades, buy/sell notional, first/last time, flags."""
    buy = F.when(is_buy(), F.col("notional_usdc")).otherwise(0.0)
    stats = tape.groupBy("wallet", "market_id").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(buy).alias("total_buy_notional"),
        F.sum(F.col("notional_usdc") - buy).alias("total_sell_notional"),
        F.min("timestamp_ms").alias("first_trade_ts"), F.max("timestamp_ms").alias("last_trade_ts"))
    flags = alerts.groupBy("wallet", "market_id").agg(F.count(F.lit(1)).alias("flag_count"), F.max("timestamp_ms").alias("last_flag_ts"))
    return stats.join(flags, ["wallet", "market_id"], "left").withColumn("flag_count", F.coalesce("flag_count", F.lit(0).cast("long")))


def wallet_outcome_positions(tape: DataFrame) -> DataFrame:
    def part(value: str, buys: bool) -> Column:
        return F.sum(F.when(is_buy() if buys else ~is_buy(), F.col(value)).otherwise(0.0))
    return tape.groupBy("wallet", "market_id", "outcome_index").agg(
        F.sum(signed_tokens()).alias("net_shares"), part("size_tokens", True).alias("buy_shares"), part("size_tokens", False).alias("sell_shares"),
        part("notional_usdc", True).alias("buy_notional"), part("notional_usdc", False).alias("sell_notional"))


def participation_log(tape: DataFrame) -> DataFrame:
    """One entry per (market, wallet, second, direction, outcome); the first trade's size."""
    rows = tape.select("market_id", "wallet", F.floor(F.col("timestamp_ms") / 1000).alias("timestamp_s"), "side", "outcome_index",
                       F.col("notional_usdc").alias("size"), "seq")
    return first_per_key(rows, ["market_id", "wallet", "timestamp_s", "side", "outcome_index"], ["seq"])


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """Replace a table atomically: write a new version folder, readers follow the newest."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a table; versions are found by the names of their files."""
    folder = folder.rstrip("/")
    newest = max(int(re.search("version=([0-9]+)/", path)[1]) for path in spark.read.parquet(folder).inputFiles())
    return spark.read.parquet(f"{folder}/version={newest}")


def export_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def resolution_payload(resolutions: DataFrame) -> DataFrame:
    """market_id and its {slug, winner, date, note} JSON."""
    return resolutions.select("market_id", F.to_json(F.struct(
        F.col("market_slug").alias("slug"), F.col("winner").alias("winning_outcome"), "resolution_date", "note")).alias("payload"))


def resolution_job_summary(resolutions: DataFrame) -> DataFrame:
    s = F.col("status")
    return resolutions.agg(F.count(F.lit(1)).alias("markets"), F.count_if(s == "resolved").alias("resolved"),
                           F.count_if(s == "unresolved").alias("unresolved"), F.count_if(s == "no_trades").alias("no_trades"),
                           F.min("close_ms").alias("min_close_ms"), F.max("close_ms").alias("max_close_ms"))
