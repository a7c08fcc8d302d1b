"""Reports over stats, alerts, clusters and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapescope.functions.stats import div
from tapescope.operators.markets import top_k
from tapescope.operators.quantiles import join_medians


def stats_with_clusters(stats: DataFrame, member: DataFrame, meta: DataFrame) -> DataFrame:
    """Wallet stats LEFT JOIN assignment LEFT JOIN cluster metadata, with defaults."""
    a = member.select("market_id", F.col("node").alias("wallet"), F.col("community").alias("cluster_id"))
    m = meta.select("market_id", F.col("community").alias("cluster_id"), F.col("size").alias("cluster_size"), F.col("density").alias("cluster_density"))
    df = stats.join(a, ["market_id", "wallet"], "left").join(m, ["market_id", "cluster_id"], "left")
    return df.withColumns({"cluster_size": F.coalesce("cluster_size", F.lit(0).cast("long")), "cluster_density": F.coalesce("cluster_density", F.lit(0.0)),
                           "flag_rate": div(F.col("flag_count"), F.col("trade_count"))})


def suspects(joined: DataFrame, min_trades: int, threshold: float) -> DataFrame:
    return joined.where((F.col("trade_count") >= min_trades) & (F.col("flag_rate") >= threshold)).orderBy(F.desc("flag_rate"), F.desc("flag_count"))


def system_summary(stats: DataFrame, alerts: DataFrame) -> DataFrame:
    a = stats.agg(F.countDistinct("wallet").alias("wallets"), F.count(F.lit(1)).alias("pairs"), F.sum("trade_count").alias("trades"),
                  F.sum("flag_count").alias("flags"), F.countDistinct("market_id").alias("markets"))
    b = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("wallet").alias("alert_wallets"), F.sum("notional_usdc").alias("alert_volume"))
    return a.crossJoin(b)


def detector_counts(alert_rows: DataFrame) -> DataFrame:
    """Count detectors from the stored signals text."""
    parts = alert_rows.select(F.explode(F.split("signals", r" \| ")).alias("_p"))
    return parts.select(F.trim(F.regexp_replace("_p", r"\(.*$", "")).alias("detector")).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


def markets_by_alerts(alerts: DataFrame, k: int = 20) -> DataFrame:
    return alerts.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.countDistinct("wallet").alias("wallets"), F.sum("notional_usdc").alias("volume"),
        F.avg("total_score").alias("avg_score")).orderBy(F.desc("alerts"), "market_id").limit(k)


def top_wallets(alerts: DataFrame, k: int = 20) -> DataFrame:
    buy = F.sum(F.when(F.col("side") == "BUY", F.col("notional_usdc")).otherwise(0.0))
    return (alerts.groupBy("wallet").agg(F.count(F.lit(1)).alias("alerts"), F.sum("notional_usdc").alias("volume"), F.avg("total_score").alias("avg_score"),
                                         F.max("total_score").alias("max_score"), buy.alias("buy_volume"))
            .where("buy_volume > 0").orderBy(F.desc("alerts"), F.desc("volume"), "wallet").limit(k))


def wallet_profiles(stats: DataFrame, alerts: DataFrame, transfers: DataFrame, k: int = 5) -> DataFrame:
    """Per wallet: markets, trades, flags, k best alerts, k largest counterparties."""
    base = stats.groupBy("wallet").agg(F.count(F.lit(1)).alias("markets"), F.sum("trade_count").alias("trades"), F.sum("flag_count").alias("flags"))
    best = top_k(alerts.select("wallet", "total_score", "seq"), ["wallet"], [F.desc("total_score"), F.asc("seq")], k).groupBy("wallet").agg(
        F.max("total_score").alias("best_score"), F.sum("seq").alias("best_seq_sum"), F.count(F.lit(1)).alias("best_n"))
    out = transfers.groupBy(F.col("from_address").alias("wallet"), "to_address").agg(F.sum("value_usdc").alias("amount"))
    sent = top_k(out, ["wallet"], [F.desc("amount"), F.asc("to_address")], k).groupBy("wallet").agg(F.sum("amount").alias("top_sent"))
    return base.join(best, "wallet", "left").join(sent, "wallet", "left")


def market_wallets(stats: DataFrame) -> DataFrame:
    return stats.withColumn("flag_rate", div(F.col("flag_count"), F.col("trade_count"))).orderBy("market_id", F.desc("flag_rate"), "wallet")


def evaluate_market(evals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Suspects against others per market: count, medians and total profit."""
    rows = evals.withColumn("is_suspect", F.col("flag_rate") >= threshold)
    keys = ["market_id", "is_suspect"]
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("wallets"), F.sum("net_pnl").alias("total_pnl"))
    return join_medians(agg, rows, keys, {"median_pnl": F.col("net_pnl"), "median_return": F.col("wallet_return")})


def most_profitable(evals: DataFrame, threshold: float = 0.5, k: int = 20) -> DataFrame:
    """The ``k`` wallets of each market that earned most, suspects marked."""
    rows = evals.withColumn("is_suspect", F.col("flag_rate") >= threshold)
    return top_k(rows.select("market_id", "wallet", "is_suspect", "trade_count", "num_flags", "flag_rate", "net_pnl", "wallet_return"), ["market_id"], [F.desc("net_pnl"), F.asc("wallet")], k)


def top_alerts(alerts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest alerts of each wallet with the detectors that fired."""
    from tapescope.operators.scoring import fired

    named = alerts.withColumn("detectors", fired(alerts)).select("wallet", "market_id", "seq", "side", "notional_usdc", "timestamp_ms", "total_score", "detectors")
    return top_k(named, ["wallet"], [F.desc("total_score"), F.asc("seq")], k)


def wallet_parts(stats: DataFrame, positions: DataFrame, transfers: DataFrame, member: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """One row a wallet: bought, open positions and their shares, largest counterparties either way, clusters and the largest of them."""
    base = stats.groupBy("wallet").agg(F.sum("total_buy_notional").alias("bought"))
    held = F.abs(F.col("net_shares")) > 1e-9
    open_ = positions.groupBy("wallet").agg(F.count_if(held).alias("open_positions"), F.sum(F.when(F.col("net_shares") > 0, F.col("net_shares")).otherwise(0.0)).alias("long_shares"))
    ways = wallet_transfers(transfers, k).groupBy("wallet").agg(*[
        F.sum(F.when(F.col("way") == way, F.col("amount"))).alias(name) for way, name in (("out", "top_sent"), ("in", "top_received"))])
    own = member.join(meta.select("market_id", "community", "size"), ["market_id", "community"]).groupBy(F.col("node").alias("wallet")).agg(
        F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest_cluster"))
    return base.join(open_, "wallet", "left").join(ways, "wallet", "left").join(own, "wallet", "left").fillna(0, ["open_positions", "clusters"])


def cluster_transfers(links: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest transfers between members of each cluster."""
    return top_k(links, ["market_id", "community"], [F.desc("amount"), F.asc("src"), F.asc("dst")], k)


def cluster_detail(member: DataFrame, alerts: DataFrame, stats: DataFrame) -> DataFrame:
    """Members of each cluster with alert count, volume, buy volume and the number of markets they trade in."""
    buy = F.when(F.col("side") == "BUY", F.col("notional_usdc")).otherwise(0.0)
    a = alerts.groupBy("market_id", "wallet").agg(F.count(F.lit(1)).alias("alerts"), F.sum("notional_usdc").alias("volume"), F.sum(buy).alias("buy_volume"))
    m = member.select("market_id", F.col("node").alias("wallet"), "community")
    n = stats.groupBy("wallet").agg(F.countDistinct("market_id").alias("markets"))
    return m.join(a, ["market_id", "wallet"], "left").join(n, "wallet", "left").fillna(0, ["alerts", "markets"]).fillna(0.0, ["volume", "buy_volume"])


def attribution_summary(edges: DataFrame, cache: DataFrame) -> DataFrame:
    a = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_address").alias("senders"), F.countDistinct("to_address").alias("receivers"),
                  F.sum("amount").alias("total_amount"), F.sum("tx_count").alias("total_transfers"))
    b = cache.agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") != "complete").alias("incomplete"))
    return a.crossJoin(b)


def transfer_edges(transfers: DataFrame) -> DataFrame:
    """Transfers per (from, to): amount, count, first and last time."""
    return transfers.groupBy("from_address", "to_address").agg(
        F.sum("value_usdc").alias("amount"), F.count(F.lit(1)).alias("tx_count"), F.min("timestamp_s").alias("first_ts"), F.max("timestamp_s").alias("last_ts"))


def transfer_hashes(transfers: DataFrame) -> DataFrame:
    """The hashes of every (from, to), one row each."""
    return transfers.select("from_address", "to_address", "tx_hash").distinct()


def wallet_transfers(transfers: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` incoming and outgoing counterparties of every wallet."""
    e = transfer_edges(transfers)
    out = e.select(F.col("from_address").alias("wallet"), F.lit("out").alias("way"), F.col("to_address").alias("other"), "amount")
    into = e.select(F.col("to_address").alias("wallet"), F.lit("in").alias("way"), F.col("from_address").alias("other"), "amount")
    return top_k(out.unionByName(into), ["wallet", "way"], [F.desc("amount"), F.asc("other")], k)


def legs(fills: DataFrame, takers: bool = True) -> DataFrame:
    """Maker legs, and taker legs when wanted, as (seq, market, wallet, usd, timestamp)."""
    cols = ["seq", "market_id", "usd_amount", "timestamp"]
    m = fills.select(*cols, F.lower("maker").alias("wallet"))
    return m.unionByName(fills.select(*cols, F.lower("taker").alias("wallet"))) if takers else m


def wallets_by_cutoff(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Wallets in all, and wallets whose largest trade reaches each cutoff."""
    top = rows.groupBy("wallet").agg(F.max("usd_amount").alias("_max"))
    return top.crossJoin(F.broadcast(cutoffs)).groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("total_wallets"), F.count_if(F.col("_max") >= F.col("cutoff")).alias("wallets"))


def wallet_universe(rows: DataFrame) -> DataFrame:
    return rows.groupBy("wallet").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.max("usd_amount").alias("max_notional"))


def participation_counts(fills: DataFrame, wallets: DataFrame) -> DataFrame:
    """Fills per (market, wallet) as maker or taker; a self-trade counts once."""
    rows = legs(fills).select("seq", "market_id", "wallet").distinct()
    return rows.join(wallets, "wallet", "left_semi").groupBy("market_id", "wallet").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of non-zero scores with its cumulative share."""
    from pyspark.sql import Window
    s = scored.where("total_score > 0")
    lim = s.agg(F.min("total_score").alias("_lo"), F.max("total_score").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col("total_score") - F.col("_lo")) / step))
    hist = s.crossJoin(F.broadcast(lim)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # at most ``bins`` rows
    return hist.withColumn("cdf", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w))


def detector_combinations(scored: DataFrame, k: int = 20) -> DataFrame:
    from tapescope.operators.scoring import fired
    names = F.array_sort(fired(scored))
    return (scored.where("is_alert").groupBy(F.concat_ws(", ", names).alias("detectors"), F.size(names).alias("num_detectors"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "detectors").limit(k))


def rank_flagged_wallets(scored: DataFrame, k: int = 50) -> DataFrame:
    from tapescope.operators.scoring import fired
    a = scored.where("is_alert")
    base = a.groupBy("wallet").agg(F.count(F.lit(1)).alias("alert_count"), F.avg("total_score").alias("avg_score"),
                                   F.countDistinct("market_id").alias("markets_affected"), F.sum("notional_usdc").alias("total_notional"))
    # at most one name per detector
    names = a.select("wallet", F.explode(fired(a)).alias("_d")).distinct().groupBy("wallet").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("_d"))).alias("detectors"))
    df = base.join(names, "wallet").withColumn(
        "rank_score", F.col("alert_count") * 0.4 + F.col("avg_score") * 30 * 0.3 + F.col("markets_affected") * 5 * 0.3)
    return df.orderBy(F.desc("rank_score"), "wallet").limit(k)


def compare_configs(scored: DataFrame) -> DataFrame:
    """Per config: trades, alerts, alert rate, markets, fires per detector."""
    from tapescope.operators.scoring import conf_columns
    return scored.groupBy("config").agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if("is_alert").alias("total_alerts"),
        (F.count_if("is_alert") / F.count(F.lit(1))).alias("alert_rate"), F.countDistinct("market_id").alias("markets_tested"),
        *[F.count_if(F.col(c) > 0).alias(f"{c.removeprefix('conf_')}_fires") for c in conf_columns(scored)])
