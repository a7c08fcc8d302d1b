"""Readers and normalisers for raw inputs (CSV, Parquet, JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET_SCHEMA = ("id long, condition_id string, market_slug string, token1 string, token2 string, answer1 string, "
                 "answer2 string, volume double, closedTime string")
FILL_SCHEMA = ("timestamp string, market_id long, maker string, taker string, nonusdc_side string, maker_direction string, "
               "taker_direction string, price double, usd_amount double, token_amount double, transactionHash string")
TRADE_JSON = ("proxyWallet string, conditionId string, slug string, side string, outcome string, outcomeIndex string, size string, "
              "price string, timestamp string, transactionHash string, asset string")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key; an aggregate, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """Market metadata CSV, typed, one row per id."""
    df = spark.read.csv(path, header=True, schema=MARKET_SCHEMA)
    return first_per_key(df, ["id"], ["market_slug"])


def read_fills(spark: SparkSession, path: str, fmt: str = "parquet", **filters) -> DataFrame:
    reader = spark.read if fmt == "parquet" else spark.read.schema(FILL_SCHEMA).option("header", True)
    return filter_fills(reader.format(fmt).load(path), **filters)


def filter_fills(fills: DataFrame, market_ids: list[int] | None = None, min_usd: float | None = None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """Filters that reach the scan; times are ISO text and compare as text."""
    df = fills
    if market_ids is not None:
        df = df.where(F.col("market_id").isin(market_ids))
    if min_usd is not None:
        df = df.where(F.col("usd_amount") >= min_usd)
    if start is not None:
        df = df.where(F.col("timestamp") >= start)
    if end is not None:
        df = df.where(F.col("timestamp") <= end)
    return df


def epoch_ms(text: Column) -> Column:
    """Epoch seconds, epoch ms, fractional seconds or ISO text (with or without Z) to epoch ms."""
    number = text.try_cast("double")
    iso = F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, "Z$", "")))
    return F.coalesce(F.when(F.abs(number) < 1e10, (number * 1000).cast("long")).otherwise(number.cast("long")), iso)


def fills_to_trades(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Maker leg of each fill as a trade, with the market's fields."""
    m = markets.select("market_id", "market_slug", "category")
    return fills.join(m, "market_id").select(
        "seq", "market_id", "market_slug", "category", F.col("maker").alias("wallet"),
        F.when(F.col("nonusdc_side") == "token1", 0).otherwise(1).alias("outcome_index"),
        F.when(F.upper("maker_direction") == "BUY", "BUY").otherwise("SELL").alias("side"),
        "price", F.col("usd_amount").alias("notional_usdc"), F.col("token_amount").alias("size_tokens"),
        epoch_ms(F.col("timestamp")).alias("timestamp_ms"), F.col("transactionHash").alias("tx_hash"))


def parse_trade_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """API trade records, numbers as numbers or as text; rows that do not parse are dropped."""
    t = raw.select(F.from_json(column, TRADE_JSON, {"mode": "PERMISSIVE"}).alias("_t")).select("_t.*")
    t = t.withColumns({**{c: F.col(c).try_cast("double") for c in ("size", "price")}, "timestamp": F.col("timestamp").try_cast("double").cast("long"),
                       "outcomeIndex": F.col("outcomeIndex").try_cast("int")})
    p = t.where("proxyWallet is not null and conditionId is not null and size is not null and price is not null and timestamp is not null")
    return p.select(
        F.col("proxyWallet").alias("wallet"), F.col("conditionId").alias("condition_id"), F.col("slug").alias("market_slug"), "side", "outcome",
        F.col("outcomeIndex").alias("outcome_index"), F.col("size").alias("size_tokens"), "price",
        (F.col("size") * F.col("price")).alias("notional_usdc"), (F.col("timestamp") * 1000).alias("timestamp_ms"),
        F.col("transactionHash").alias("tx_hash"), "asset")


def parse_market_json(df: DataFrame) -> DataFrame:
    """token_ids (JSON array or comma list), outcomes (JSON), question with its event title; markets without tokens are dropped."""
    as_json = F.from_json("token_ids", "array<string>")
    as_list = F.filter(F.transform(F.split(F.regexp_replace("token_ids", r'[\[\]"]', ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    title = F.coalesce(F.col("event_title"), F.lit(""))
    titled = (title == "") | F.contains(F.lower("question"), F.lower(title))
    parsed = df.withColumns({
        "token_ids": F.when(F.trim(F.col("token_ids")).startswith("["), as_json).otherwise(as_list),
        "outcomes": F.from_json("outcomes", "array<string>"),
        "question": F.when(titled, F.col("question")).otherwise(F.concat(title, F.lit(": "), F.col("question")))})
    return parsed.where(F.size("token_ids") > 0)


def normalize_transfers(raw: DataFrame, decimals: int = 6) -> DataFrame:
    """Lower-case hashes and addresses, scale values, drop invalid rows, dedup (tx, from, to)."""
    df = raw.select(
        F.lower(F.trim("hash")).alias("tx_hash"), F.lower(F.trim("from")).alias("from_address"), F.lower(F.trim("to")).alias("to_address"),
        F.expr("try_cast(timeStamp AS bigint)").alias("timestamp_s"), F.expr("try_cast(blockNumber AS bigint)").alias("block_number"),
        (F.expr("try_cast(value AS double)") / 10.0 ** decimals).alias("value_usdc"))
    ok = df.where("tx_hash <> '' and from_address <> '' and to_address <> '' and value_usdc is not null and timestamp_s is not null")
    return first_per_key(ok, ["tx_hash", "from_address", "to_address"], ["timestamp_s", "block_number", "value_usdc"])


def parse_book_snapshot(df: DataFrame) -> DataFrame:
    """Keep levels with positive price and size; bids falling, asks rising."""
    def good(side: str) -> Column:
        return F.filter(side, lambda lv: (lv["price"] > 0) & (lv["size"] > 0))
    return df.withColumns({"bids": F.sort_array(good("bids"), asc=False), "asks": F.sort_array(good("asks"))})


def read_resolution_overrides(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON map of market id to a winner or to {winning_outcome, resolution_date, note}."""
    kv = raw.select(F.explode(F.from_json(column, "map<string,string>")).alias("id", "v"))
    rec = F.from_json("v", "winning_outcome int, resolution_date string, note string")
    df = kv.select(F.expr("try_cast(id AS bigint)").alias("market_id"),
                   F.coalesce(F.expr("try_cast(v AS int)"), rec["winning_outcome"]).alias("winner"),
                   rec["resolution_date"].alias("resolution_date"), F.coalesce(rec["note"], F.lit("")).alias("note"))
    return df.where("market_id is not null and winner is not null")


# The categories the classifier may return, and those whose outcome somebody can know before it is announced.
PLAUSIBLE_CATEGORIES = ["ELECTION", "EARNINGS", "POLICY", "GEOPOLITICAL", "APPOINTMENT", "LEGAL", "PRODUCT_LAUNCH", "OTHER_ANNOUNCEMENT"]
OTHER_CATEGORIES = ["CRYPTO_PRICE", "SPORTS", "WEATHER", "ENTERTAINMENT", "SCIENCE", "GRADUAL", "OTHER"]


def normalize_classifications(df: DataFrame) -> DataFrame:
    """Upper-case known category, confidence in [0, 1], plausibility by category, ``status``.

    An entry that says it failed, or has no known category, is a failed one:
    no category, confidence 0, not plausible.
    """
    cat = F.upper(F.trim("category"))
    told = F.col("status") if "status" in df.columns else F.lit(None).cast("string")
    ok = F.coalesce(cat.isin(PLAUSIBLE_CATEGORIES + OTHER_CATEGORIES), F.lit(False)) & ~told.eqNullSafe("failed")
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence"), F.lit(0.0))))
    return df.withColumns({
        "category": F.when(ok, cat), "confidence": F.when(ok, conf).otherwise(0.0), "status": F.when(ok, "success").otherwise("failed"),
        "insider_plausible": ok & F.coalesce(cat.isin(PLAUSIBLE_CATEGORIES), F.lit(False))})


def align_classifications(expected: DataFrame, results: DataFrame, order: list[str]) -> DataFrame:
    """First result per expected id; ids without one are reported missing."""
    first = first_per_key(results, ["market_id"], order)
    return expected.join(first, "market_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


WALLET_PATTERN = "^0x[0-9a-f]{40}$"


def read_reported_cases(df: DataFrame) -> DataFrame:
    """(case_id, wallet, valid, times): cleaned reported wallets, distinct per case."""
    rows = df.select("case_id", F.explode("reported_wallets").alias("raw")).withColumn("wallet", F.lower(F.trim("raw")))
    return rows.groupBy("case_id", "wallet").agg(F.count(F.lit(1)).alias("times")).withColumn(
        "valid", F.col("wallet").rlike(WALLET_PATTERN))


def market_prompt_text(df: DataFrame) -> DataFrame:
    """First non-empty of question, title, description ("nan" counts as empty)."""
    def real(c: str) -> Column:
        t = F.trim(F.col(c))
        return F.when((t != "") & (F.lower(t) != "nan"), t)
    return df.withColumn("prompt", F.coalesce(real("question"), real("title"), real("description"), F.lit("")))
