"""Market outcomes and wallet ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.operators.state import ORDER, is_buy, signed_tokens


def last_prices(tape: DataFrame) -> DataFrame:
    """Last traded price per (market, outcome); the later row wins a tie in time."""
    return tape.groupBy("market_id", "outcome_index").agg(
        F.max_by("price", F.struct(*ORDER)).alias("last_price"),
        F.count(F.lit(1)).alias("n"), F.max("timestamp_ms").alias("last_ts"))


def winners(tape: DataFrame, threshold: float = 0.99) -> DataFrame:
    """(market_id, winner): outcome with the highest last price at or above the threshold."""
    return (last_prices(tape).where(F.col("last_price") >= threshold).groupBy("market_id")
            .agg(F.max_by("outcome_index", "last_price").alias("winner")))


def resolution_table(tape: DataFrame, markets: DataFrame, threshold: float = 0.99, min_trades: int = 0) -> DataFrame:
    """One row per market: inferred winner, status, trade count, latest trade."""
    qualifies = F.col("last_price") >= threshold
    per_market = last_prices(tape).groupBy("market_id").agg(
        F.max_by("outcome_index", F.when(qualifies, F.col("last_price"))).alias("winner"),
        F.sum("n").alias("n_trades"), F.max("last_ts").alias("latest_trade_ts_ms"))
    df = markets.join(per_market, "market_id", "left")
    n = F.coalesce("n_trades", F.lit(0).cast("long"))
    ok = F.col("winner").isNotNull() & (n >= min_trades)
    return df.withColumns({
        "n_trades": n,
        "winner": F.when(ok, F.col("winner")),
        "status": F.when(n == 0, "no_trades").when(ok, "resolved").otherwise("unresolved")})


def winner_precedence(*tables: DataFrame) -> DataFrame:
    """First non-null winner per market over the tables, most trusted first."""
    out = tables[0].select("market_id", F.col("winner").alias("_w0"))
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select("market_id", F.col("winner").alias(f"_w{i}")), "market_id", "full")
    return out.select("market_id", F.coalesce(*[F.col(f"_w{i}") for i in range(len(tables))]).alias("winner"))


def wallet_positions(tape: DataFrame, by_outcome: bool = False) -> DataFrame:
    """Net shares, net cost, notional, gross buys and trades per (market, wallet[, outcome])."""
    keys = ["market_id", "wallet", *(["outcome_index"] if by_outcome else [])]
    return tape.groupBy(*keys).agg(
        F.sum(signed_tokens()).alias("net_shares"),
        F.sum(F.when(is_buy(), F.col("notional_usdc")).otherwise(-F.col("notional_usdc"))).alias("net_cost"),
        F.sum("notional_usdc").alias("notional"),
        F.sum(F.when(is_buy(), F.col("notional_usdc")).otherwise(0.0)).alias("gross_buy"),
        F.count(F.lit(1)).alias("trade_count"))


def wallet_pnl(tape: DataFrame, winners: DataFrame, min_notional: float = 500.0) -> DataFrame:
    """Profit of each eligible wallet of a resolved market if held to resolution."""
    rows = tape.join(winners, "market_id")
    won = F.col("outcome_index") == F.col("winner")
    agg = rows.groupBy("market_id", "winner", "wallet").agg(
        F.sum(F.when(won, signed_tokens()).otherwise(0.0)).alias("payout"),
        F.sum(F.when(is_buy(), F.col("notional_usdc")).otherwise(-F.col("notional_usdc"))).alias("net_cost"),
        F.sum("notional_usdc").alias("total_notional"),
        F.sum(F.when(is_buy(), F.col("notional_usdc")).otherwise(0.0)).alias("gross_buy"),
        F.count(F.lit(1)).alias("trade_count"))
    pnl = F.col("payout") - F.col("net_cost")
    ret = F.when(F.col("gross_buy") > 1e-9, F.col("net_pnl") / F.col("gross_buy")).otherwise(0.0)
    return (agg.where(F.col("total_notional") >= min_notional).withColumn("net_pnl", pnl)
            .withColumn("wallet_return", ret)
            .withColumn("informed_score", F.when(
                F.col("gross_buy") > 0,
                F.col("wallet_return") * F.log2(1.0 + F.col("gross_buy") / 1000.0)).otherwise(0.0)))


def label(pnl: DataFrame, metric: str = "return", z_threshold: float = 2.0, min_wallets: int = 3,
          require_buys: bool = False) -> DataFrame:
    """z-score each wallet inside its market; high z marks an informed wallet.

    Mean and deviation come from one aggregate per market (partial sums before
    the shuffle) joined back, not from a window over all wallets of a market.
    """
    base = pnl.where("gross_buy > 0") if require_buys else pnl
    value = F.col("wallet_return") if metric == "return" else F.col("net_pnl")
    rows = base.withColumn("label_value", value)
    stats = rows.groupBy("market_id").agg(
        F.avg("label_value").alias("label_mean"), F.stddev_samp("label_value").alias("label_std"),
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_wallets).drop("_n")
    z = F.when(F.col("label_std") > 1e-12, (F.col("label_value") - F.col("label_mean")) / F.col("label_std")).otherwise(0.0)
    return (rows.join(stats, "market_id").withColumn("z_score", z)
            .withColumn("is_insider", F.col("z_score") > z_threshold))


def ground_truth(tape: DataFrame, winners: DataFrame, cfg: dict) -> DataFrame:
    """Labels for every wallet of every resolved market in one pass."""
    c = cfg["labels"]
    return label(wallet_pnl(tape, winners, c["min_wallet_notional"]), c["metric"], c["z_score_threshold"],
                 c["min_wallets"])


def resolution_return() -> Column:
    """Return of a BUY held to resolution: (1-p)/p if it wins, else -1."""
    won = F.col("outcome_index") == F.col("winner")
    return F.when(won, F.when(F.col("price") > 1e-9, (1.0 - F.col("price")) / F.col("price")).otherwise(0.0)).otherwise(-1.0)


def buy_returns(tape: DataFrame, winners: DataFrame) -> DataFrame:
    """BUY trades of resolved markets with their resolution return and profit."""
    buys = tape.where(is_buy()).join(winners, "market_id")
    won = F.col("outcome_index") == F.col("winner")
    payout = F.when(won, F.col("size_tokens")).otherwise(0.0)
    return buys.withColumns({
        "is_win": won, "trade_return": resolution_return(), "payout": payout,
        "pnl": payout - F.col("notional_usdc"),
        "pnl_return": F.when(F.col("notional_usdc") > 1e-9,
                             (payout - F.col("notional_usdc")) / F.col("notional_usdc")).otherwise(0.0)})
