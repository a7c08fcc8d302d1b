"""The surveillance tables, derived from the star-schema and event tables.

``events`` plays the trade tape, ``nation``/``region`` the markets, ``orders``
the token transfers and ``lineitem`` the order books.  Each function reads only
the columns it needs, so the Parquet scan is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_MARKETS = 25
WALLET_COLUMNS = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without a zone are UTC
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wallet_of(col: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(col.cast("string"), WALLET_COLUMNS, "0"))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised trades; ``(timestamp_ms, seq)`` is a total order."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    buys = F.col("event_type").isin("purchase", "signup", "view")
    return e.select(
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        wallet_of(F.col("user_id")).alias("wallet"),
        F.pmod("event_id", F.lit(N_MARKETS)).cast("int").alias("market_id"),
        F.pmod(k, F.lit(2)).cast("int").alias("outcome_index"),
        F.when(buys, "BUY").otherwise("SELL").alias("side"),
        ((k + 1) / F.lit(101.0)).alias("price"),
        (F.col("value") * 100.0).alias("notional_usdc"),
        (F.col("value") * 100.0 / ((k + 1) / F.lit(101.0))).alias("size_tokens"),
        F.concat(F.lit("tx"), F.col("event_id").cast("string")).alias("tx_hash"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: number of wallets, ``n``."""
    return read(spark, sf_dir, "events").select(F.countDistinct("user_id").alias("n"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market metadata with volume and close time taken from the tape."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    t = tape(spark, sf_dir).groupBy("market_id").agg(
        F.sum("notional_usdc").alias("volume"), F.max("timestamp_ms").alias("close_ms"))
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").alias("market_id"), F.col("n_name").alias("market_slug"),
                    F.col("r_name").alias("category"))
            .join(t, "market_id", "left"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token transfers between wallets, in seconds."""
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(users(spark, sf_dir)))
    return o.select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tx_hash"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp_s"),
        wallet_of(F.pmod("o_custkey", "n")).alias("from_address"),
        wallet_of(F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.col("n"))).alias("to_address"),
        F.col("o_totalprice").alias("value_usdc"))


#: The first snapshot day of the books, in days since 1970 (the eve of the tape), and their number.
BOOK_DAY, BOOK_DAYS = 19_722, 30


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of each asset (market * 2 + outcome), one a day at most, from all rows of ``lineitem``.

    Odd line numbers are bids, even ones asks; the ship date says which day's snapshot a level is in.
    """
    li = read(spark, sf_dir, "lineitem")
    asset = F.pmod("l_partkey", F.lit(2 * N_MARKETS)).cast("int")
    is_bid = F.col("l_linenumber") % 2 == 1
    level = F.round(F.when(is_bid, 0.50 - F.col("l_discount")).otherwise(0.51 + F.col("l_tax")), 4)
    day = F.pmod(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")), F.lit(BOOK_DAYS)) + BOOK_DAY
    levels = li.groupBy(asset.alias("asset_id"), (day.cast("long") * 86_400_000).alias("timestamp_ms"), is_bid.alias("is_bid"), level.alias("price")).agg(
        F.sum("l_quantity").alias("size"))
    return book_levels_to_snapshots(levels)


def book_levels_to_snapshots(levels: DataFrame) -> DataFrame:
    """(asset, time, is_bid, price, size) rows to one row with both sides sorted.

    A book holds one level per price tick, which bounds the collected arrays.
    """
    pair = F.struct("price", "size")
    agg = levels.groupBy("asset_id", "timestamp_ms").agg(
        F.collect_list(F.when(F.col("is_bid"), pair)).alias("bids"),
        F.collect_list(F.when(~F.col("is_bid"), pair)).alias("asks"))
    return agg.select("asset_id", "timestamp_ms",
                      F.sort_array("bids", asc=False).alias("bids"), F.sort_array("asks").alias("asks"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw exchange fills with a maker and a taker leg, time as ISO text."""
    t = tape(spark, sf_dir)
    u = F.broadcast(users(spark, sf_dir))
    user = F.regexp_replace("wallet", "^0x0*(?=[0-9])", "").cast("long")
    return t.crossJoin(u).select(
        "seq",
        F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
        "market_id", F.col("wallet").alias("maker"),
        wallet_of(F.pmod(user + 1, F.col("n"))).alias("taker"),
        F.when(F.col("outcome_index") == 0, "token1").otherwise("token2").alias("nonusdc_side"),
        F.col("side").alias("maker_direction"),
        F.when(F.col("side") == "BUY", "SELL").otherwise("BUY").alias("taker_direction"),
        "price", F.col("notional_usdc").alias("usd_amount"), F.col("size_tokens").alias("token_amount"),
        F.col("tx_hash").alias("transactionHash"))
