"""Queries over market selection, joins, set operations and reports."""

from pyspark.sql import functions as F

from tapescope.operators import graph, labels, markets, reports, scoring
from tapescope.operators.running import DAY_MS
from tapescope.plans.base import CFG, evaluations, frozen, rnd, scored, tape, winners
from tapescope.plans.evaluate import r, rounded
from tapescope.plans.graphs import member, metadata
from tapescope.plans.ingest import SIGNALS_SQL, STATS_SQL
from tapescope.plans.registry import query, view
from tapescope.sources import sinks, tables

T0 = 1704067200000  # 2024-01-01, the first day of the tape
view("wstats", STATS_SQL)
view("alerts", "SELECT * FROM scored WHERE is_alert")


@query("filter_notional", "SELECT seq FROM tape WHERE notional_usdc>=2500")
def _(spark, sf):
    return markets.filter_notional(tape(spark, sf), 2500.0).select("seq")


@query("filter_time_window", f"SELECT seq FROM tape WHERE timestamp_ms BETWEEN {T0 + 5 * DAY_MS} AND {T0 + 20 * DAY_MS}")
def _(spark, sf):
    return markets.filter_time_window(tape(spark, sf), T0 + 5 * DAY_MS, T0 + 20 * DAY_MS).select("seq")


@query("cap_at_market_close", f"SELECT seq FROM tape JOIN (SELECT market_id, close_ms-{DAY_MS} AS c FROM markets) m USING (market_id) WHERE timestamp_ms<=least(c,{T0 + 29 * DAY_MS})")
def _(spark, sf):
    m = tables.markets(spark, sf).withColumn("close_ms", F.col("close_ms") - DAY_MS)
    return markets.cap_at_close(tape(spark, sf), m, T0 + 29 * DAY_MS).select("seq")


@query("markets_by_volume", "SELECT market_id, round(volume,2) AS volume FROM markets WHERE volume>=1000 ORDER BY volume DESC, market_id LIMIT 10")
def _(spark, sf):
    return rounded(markets.markets_by_volume(tables.markets(spark, sf), 1000.0, 10).select("market_id", "volume"), 2)


@query("search_markets", "SELECT keyword, doc_id AS market_id, rank, CASE WHEN doc_id % 3=0 THEN 'active' ELSE 'resolved' END AS status FROM (SELECT keyword, doc_id, row_number() OVER (PARTITION BY keyword ORDER BY n_chars DESC, doc_id) AS rank FROM documents, (SELECT unnest(['data','the','Model']) AS keyword) k WHERE contains(lower(text),lower(keyword))) WHERE rank<=20")
def _(spark, sf):
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("market_id"), "text", F.col("n_chars").cast("double").alias("volume"),
                                                   F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("close_ms"))
    kw = spark.createDataFrame([("data",), ("the",), ("Model",)], "keyword string")
    return markets.search_markets(d, kw, "text").select("keyword", "market_id", "rank", "status")


def market_classes(spark, sf):
    return tables.markets(spark, sf).select("market_id", (F.col("market_id") % 3 != 0).alias("insider_plausible"))


@query("select_markets_timeframe", f"SELECT market_id FROM markets WHERE close_ms BETWEEN {T0} AND {T0 + 40 * DAY_MS} AND volume>=1000 AND market_id % 3<>0 AND category<>'ASIA'")
def _(spark, sf):
    return markets.select_markets(tables.markets(spark, sf), market_classes(spark, sf), T0, T0 + 40 * DAY_MS, 1000.0,
                                  exclude=["asia"], plausible=True).select("market_id")


@query("market_trade_counts", "SELECT market_id, count(*) AS n_trades FROM tape WHERE notional_usdc>=500 GROUP BY 1")
def _(spark, sf):
    return markets.trade_counts(markets.filter_notional(tape(spark, sf), 500.0))


@query("filter_markets_min_trades", """WITH c AS (SELECT m.market_id, count(t.seq) AS n FROM markets m LEFT JOIN (SELECT * FROM tape WHERE notional_usdc>=5000) t USING (market_id) GROUP BY 1)
SELECT count(*) AS input_markets, count_if(n>=5) AS kept_markets, count_if(n<5) AS dropped_markets, count_if(n=0) AS zero_trade_markets, CAST(sum(n) AS BIGINT) AS total_trades,
 max(n) AS max_trades, CAST(list_sort(list(n))[CAST(floor(count(*)/2) AS BIGINT)+1] AS DOUBLE) AS median_trades FROM c""")
def _(spark, sf):
    big = markets.filter_notional(tape(spark, sf), 5000.0)
    return markets.min_trades_stats(markets.with_min_trades(tables.markets(spark, sf).select("market_id"), big, 5))


@query("train_val_split_time", "SELECT market_id, CASE WHEN row_number() OVER (ORDER BY close_ms DESC, market_id DESC)<=round_even(count(*) OVER ()*0.5,0) THEN 'val' ELSE 'train' END AS part FROM markets")
def _(spark, sf):
    return markets.train_val_split(tables.markets(spark, sf), 0.5).select("market_id", "part")


@query("split_by_close_time", "SELECT market_id, CASE WHEN row_number() OVER (ORDER BY close_ms DESC, market_id DESC)<=floor(count(*) OVER ()*0.3) THEN 'eval' ELSE 'train' END AS part FROM markets")
def _(spark, sf):
    return markets.split_by_close_time(tables.markets(spark, sf), 0.3).select("market_id", "part")


@query("month_windows", f"SELECT w AS window_no, part, count(*) AS n FROM tape, (SELECT i AS w, unnest(['train','test']) AS part, {T0}+i*{5 * DAY_MS} AS s FROM range(0,3) t(i)) g WHERE timestamp_ms>=s+CASE part WHEN 'train' THEN 0 ELSE {10 * DAY_MS} END AND timestamp_ms<s+CASE part WHEN 'train' THEN {10 * DAY_MS} ELSE {15 * DAY_MS} END GROUP BY 1,2")
def _(spark, sf):
    rows = [(i, p, T0 + i * 5 * DAY_MS + a, T0 + i * 5 * DAY_MS + b) for i in range(3) for p, a, b in (("train", 0, 10 * DAY_MS), ("test", 10 * DAY_MS, 15 * DAY_MS))]
    grid = spark.createDataFrame(rows, "window_no long, part string, start_ms long, end_ms long")
    return markets.assign_windows(tape(spark, sf), grid).groupBy("window_no", "part").agg(F.count(F.lit(1)).alias("n"))


@query("wallet_variants", "SELECT DISTINCT market_id, wallet FROM tape JOIN (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR),40,'0') AS w FROM customer) c ON substr(wallet,3)=c.w")
def _(spark, sf):
    c = tables.read(spark, sf, "customer").select(F.upper(F.lpad(F.col("c_custkey").cast("string"), 40, "0")).alias("reported"))
    pairs = tape(spark, sf).select("market_id", "wallet").distinct()
    hit = markets.plain_wallet(F.col("wallet")) == markets.plain_wallet(F.col("reported"))
    return pairs.join(c, hit, "left_semi")


@query("boost_bucket", "SELECT market_id, wallet, CASE WHEN b<1.0 OR b>2.0 THEN -1 WHEN b<1.1 THEN 0 WHEN b<1.25 THEN 1 WHEN b<1.5 THEN 2 ELSE 3 END AS bucket FROM (SELECT DISTINCT market_id, wallet, 0.9+(CAST(substr(wallet,3) AS BIGINT) % 13)/10.0 AS b FROM tape)")
def _(spark, sf):
    num = F.regexp_replace("wallet", "^0x0*(?=[0-9])", "").cast("long") % 13
    df = tape(spark, sf).select("market_id", "wallet", (F.lit(0.9) + num / 10.0).alias("b")).distinct()
    return df.select("market_id", "wallet", markets.boost_bucket(F.col("b"), [1.0, 1.1, 1.25, 1.5, 2.0]).alias("bucket"))


@query("sort_tape", "SELECT seq, timestamp_ms FROM tape ORDER BY timestamp_ms, seq LIMIT 100")
def _(spark, sf):
    return tape(spark, sf).select("seq", "timestamp_ms").orderBy("timestamp_ms", "seq").limit(100)


# ---- joins ------------------------------------------------------------------
@query("trade_market_join", "SELECT seq, market_slug, category FROM tape JOIN markets USING (market_id)")
def _(spark, sf):
    return tape(spark, sf).join(tables.markets(spark, sf), "market_id").select("seq", "market_slug", "category")


@query("asset_outcome_map", "SELECT p_partkey AS market_id, CAST(i AS INTEGER) AS outcome_index, 't'||(2*p_partkey+i) AS asset_id FROM part, range(0,2) t(i)")
def _(spark, sf):
    k = F.col("p_partkey") * 2
    m = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("market_id"), F.array(
        F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("t"), (k + 1).cast("string"))).alias("token_ids"))
    return markets.asset_outcome_map(m)


@query("stats_cluster_left_join", "SELECT s.wallet, s.market_id, m.community AS cluster_id, coalesce(c.size,0) AS cluster_size, round(coalesce(c.density,0),5) AS cluster_density, round(flag_count/trade_count,5) AS flag_rate FROM wstats s LEFT JOIN member m ON m.market_id=s.market_id AND m.node=s.wallet LEFT JOIN cmeta c ON c.market_id=m.market_id AND c.community=m.community")
def _(spark, sf):
    return joined(spark, sf).select("wallet", "market_id", "cluster_id", "cluster_size", *rnd("cluster_density", "flag_rate", digits=5))


def wstats(spark, sf):
    s = frozen(spark, sf)
    return sinks.wallet_market_stats(s, s.where("is_alert"))


def joined(spark, sf):
    m = member(spark, sf)
    return reports.stats_with_clusters(wstats(spark, sf), m, metadata(spark, sf, m))


@query("suspects", "SELECT wallet, market_id, trade_count, flag_count, round(flag_count/trade_count,5) AS flag_rate FROM wstats WHERE trade_count>=3 AND flag_count/trade_count>=0.5")
def _(spark, sf):
    return reports.suspects(joined(spark, sf), 3, 0.5).select("wallet", "market_id", "trade_count", "flag_count", *rnd("flag_rate", digits=5))


@query("unqueried_wallets", "SELECT DISTINCT wallet FROM tape WHERE wallet NOT IN (SELECT from_address FROM transfers WHERE value_usdc>300000)")
def _(spark, sf):
    done = tables.transfers(spark, sf).where("value_usdc > 300000").select(F.col("from_address").alias("wallet"))
    return tape(spark, sf).select("wallet").distinct().join(done, "wallet", "left_anti")


@query("missing_resolutions", "SELECT market_id FROM markets WHERE market_id NOT IN (SELECT market_id FROM winners)")
def _(spark, sf):
    return tables.markets(spark, sf).select("market_id").join(winners(spark, sf), "market_id", "left_anti")


@query("prior_trade_counts", """WITH f AS (SELECT market_id, min(timestamp_ms) AS t FROM tape GROUP BY 1), p AS (SELECT DISTINCT market_id, wallet FROM tape)
SELECT p.market_id, p.wallet, count(x.seq) AS prior_trades FROM p JOIN f USING (market_id) LEFT JOIN tape x ON x.wallet=p.wallet AND x.timestamp_ms<f.t GROUP BY 1,2""")
def _(spark, sf):
    return markets.prior_trade_counts(tape(spark, sf))


@query("wallet_prefix_lookup", """WITH big AS (SELECT DISTINCT wallet FROM tape WHERE notional_usdc>=15000 AND starts_with(wallet,'0x00000000000000000000000000000000000000'))
SELECT wallet, 'stats' AS found_in FROM big UNION ALL
SELECT DISTINCT wallet, 'alerts' FROM alerts WHERE starts_with(wallet,'0x00000000000000000000000000000000000000') AND wallet NOT IN (SELECT wallet FROM big)""")
def _(spark, sf):
    """Wallets by prefix in the stored statistics (here of large trades), else in the alerts."""
    p = F.startswith(F.col("wallet"), F.lit("0x00000000000000000000000000000000000000"))
    stats = tape(spark, sf).where(p & (F.col("notional_usdc") >= 15_000)).select("wallet", F.lit("stats").alias("found_in"))
    alerted = frozen(spark, sf).where("is_alert").where(p).select("wallet", F.lit("alerts").alias("found_in"))
    return stats.unionByName(alerted).groupBy("wallet").agg(F.max("found_in").alias("found_in"))


@query("config_cross_join", "SELECT CAST(c AS DOUBLE) AS min_notional, count_if(notional_usdc>=c) AS kept, count(*) AS n FROM tape, (SELECT unnest([500.0,1000.0,5000.0]) AS c) k GROUP BY 1")
def _(spark, sf):
    c = spark.createDataFrame([(500.0,), (1000.0,), (5000.0,)], "min_notional double")
    return tape(spark, sf).crossJoin(F.broadcast(c)).groupBy("min_notional").agg(
        F.count_if(F.col("notional_usdc") >= F.col("min_notional")).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("counterfactual_join", """SELECT a.market_id, a.wallet, a.num_flags AS flags_with, b.n AS flags_without FROM
 (SELECT market_id, wallet, count_if(total_score>=0.4) AS num_flags FROM scored GROUP BY 1,2) a JOIN (SELECT market_id, wallet, count_if(total_score>=0.5) AS n FROM scored GROUP BY 1,2) b USING (market_id, wallet)""")
def _(spark, sf):
    s = frozen(spark, sf)
    a = s.groupBy("market_id", "wallet").agg(F.count_if(F.col("total_score") >= 0.4).alias("flags_with"))
    b = s.groupBy("market_id", "wallet").agg(F.count_if(F.col("total_score") >= 0.5).alias("flags_without"))
    return a.join(b, ["market_id", "wallet"], "left")


# ---- aggregations -----------------------------------------------------------
@query("system_summary", "SELECT (SELECT count(DISTINCT wallet) FROM wstats) AS wallets, (SELECT count(*) FROM wstats) AS pairs, (SELECT CAST(sum(trade_count) AS BIGINT) FROM wstats) AS trades, (SELECT CAST(sum(flag_count) AS BIGINT) FROM wstats) AS flags, (SELECT count(DISTINCT market_id) FROM wstats) AS markets, count(*) AS alerts, count(DISTINCT wallet) AS alert_wallets, round(sum(notional_usdc),2) AS alert_volume FROM alerts")
def _(spark, sf):
    s = frozen(spark, sf)
    a = s.where("is_alert")
    return rounded(reports.system_summary(sinks.wallet_market_stats(s, a), a), 2)


@query("detector_counts_from_alerts", f"SELECT regexp_replace(d,'\\(.*$','') AS detector, count(*) AS n FROM (SELECT unnest(string_split(sig,' | ')) AS d FROM (SELECT {SIGNALS_SQL} AS sig FROM scored WHERE is_alert)) GROUP BY 1")
def _(spark, sf):
    return reports.detector_counts(sinks.alert_rows(scoring.alerts(frozen(spark, sf))))


@query("wallet_profile_report", """WITH b AS (SELECT wallet, count(*) AS markets, CAST(sum(trade_count) AS BIGINT) AS trades, CAST(sum(flag_count) AS BIGINT) AS flags FROM wstats GROUP BY 1),
k AS (SELECT wallet, max(total_score) AS best_score, CAST(sum(seq) AS BIGINT) AS best_seq_sum, count(*) AS best_n FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY total_score DESC, seq) AS rn FROM (SELECT wallet, round(total_score,9) AS total_score, seq FROM alerts)) WHERE rn<=5 GROUP BY 1),
s AS (SELECT wallet, sum(amount) AS top_sent FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY amount DESC, o) AS rn FROM (SELECT from_address AS wallet, to_address AS o, round(sum(value_usdc),4) AS amount FROM transfers GROUP BY 1,2)) WHERE rn<=5 GROUP BY 1)
SELECT wallet, markets, trades, flags, round(best_score,6) AS best_score, best_seq_sum, best_n, round(top_sent,2) AS top_sent FROM b LEFT JOIN k USING (wallet) LEFT JOIN s USING (wallet)""")
def _(spark, sf):
    s = frozen(spark, sf)
    a = s.where("is_alert").withColumn("total_score", F.round("total_score", 9))
    df = reports.wallet_profiles(sinks.wallet_market_stats(s, a), a, tables.transfers(spark, sf))
    return rounded(rounded(df, 2, ("best_score",)), 6)


@query("market_wallets_report", "SELECT market_id, wallet, trade_count, flag_count, round(flag_count/trade_count,5) AS flag_rate FROM wstats")
def _(spark, sf):
    return reports.market_wallets(wstats(spark, sf)).select("market_id", "wallet", "trade_count", "flag_count", *rnd("flag_rate", digits=5))


@query("evaluate_market", "SELECT market_id, flag_rate>=0.5 AS is_suspect, count(*) AS wallets, round(sum(net_pnl),2) AS total_pnl, round(median(net_pnl),2) AS median_pnl, round(median(wallet_return),5) AS median_return FROM evals GROUP BY 1,2")
def _(spark, sf):
    df = reports.evaluate_market(evaluations(spark, sf))
    return rounded(rounded(df, 2, ("median_return",)), 5)


@query("markets_by_alerts", "SELECT market_id, count(*) AS alerts, count(DISTINCT wallet) AS wallets, round(sum(notional_usdc),2) AS volume, round(avg(total_score),5) AS avg_score FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return rounded(rounded(reports.markets_by_alerts(frozen(spark, sf).where("is_alert")), 2, ("avg_score",)), 5)


@query("top_wallets", "SELECT wallet, count(*) AS alerts, round(sum(notional_usdc),2) AS volume, round(avg(total_score),5) AS avg_score, round(max(total_score),5) AS max_score, round(sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END),2) AS buy_volume FROM alerts GROUP BY 1 HAVING sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END)>0 ORDER BY 2 DESC, sum(notional_usdc) DESC, 1 LIMIT 20")
def _(spark, sf):
    return rounded(rounded(reports.top_wallets(frozen(spark, sf).where("is_alert")), 2, ("avg_score", "max_score")), 5)


@query("cluster_list", "SELECT market_id, community, size, round(density,5) AS density FROM cmeta WHERE size>=5 AND density>=0.02")
def _(spark, sf):
    df = metadata(spark, sf, member(spark, sf)).where("size >= 5 and density >= 0.02")
    return df.select("market_id", "community", "size", *rnd("density", digits=5))


@query("cluster_detail", "SELECT m.market_id, m.node AS wallet, community, coalesce(n,0) AS alerts, round(coalesce(v,0),3) AS volume, round(coalesce(b,0),3) AS buy_volume, k.markets FROM member m JOIN (SELECT wallet, count(*) AS markets FROM wstats GROUP BY 1) k ON k.wallet=m.node LEFT JOIN (SELECT market_id, wallet, count(*) AS n, sum(notional_usdc) AS v, sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END) AS b FROM alerts GROUP BY 1,2) a ON a.market_id=m.market_id AND a.wallet=m.node")
def _(spark, sf):
    s = frozen(spark, sf)
    return rounded(reports.cluster_detail(member(spark, sf), s.where("is_alert"), sinks.wallet_market_stats(s, s.where("is_alert"))), 3)


@query("cluster_transfers", """SELECT market_id, community, src, dst, rank, round(amount,2) AS amount, tx_count FROM (SELECT *, row_number() OVER (PARTITION BY market_id, community ORDER BY amount DESC, src, dst) AS rank FROM (
 SELECT a.market_id, a.community, from_address AS src, to_address AS dst, sum(value_usdc) AS amount, count(*) AS tx_count FROM transfers t JOIN member a ON a.node=t.from_address
 JOIN member b ON b.node=t.to_address AND b.market_id=a.market_id AND b.community=a.community WHERE from_address<>to_address GROUP BY 1,2,3,4)) WHERE rank<=10""")
def _(spark, sf):
    links = graph.intra_cluster_transfers(tables.transfers(spark, sf), member(spark, sf))
    return rounded(reports.cluster_transfers(links), 2)


@query("evaluate_market_top", """SELECT * FROM (SELECT market_id, wallet, flag_rate>=0.5 AS is_suspect, trade_count, num_flags, round(flag_rate,5) AS flag_rate, round(net_pnl,2) AS net_pnl, round(wallet_return,5) AS wallet_return,
 row_number() OVER (PARTITION BY market_id ORDER BY round(net_pnl,6) DESC, wallet) AS rank FROM evals) WHERE rank<=20""")
def _(spark, sf):
    df = reports.most_profitable(evaluations(spark, sf).withColumn("net_pnl", F.round("net_pnl", 6)))
    return rounded(rounded(df, 2, ("flag_rate", "wallet_return")), 5)


@query("wallet_top_alerts", f"""SELECT wallet, rank, seq, side, round(total_score,5) AS total_score, array_to_string(fl,',') AS detectors FROM (
 SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY round(total_score,9) DESC, seq) AS rank FROM (SELECT *, list_filter([{','.join(f"CASE WHEN conf_{d}>0 THEN '{d}' END" for d in ('volume_anomaly', 'probability_impact', 'accumulation', 'extreme_position', 'contra_silence'))}], lambda x: x IS NOT NULL) AS fl FROM alerts)) WHERE rank<=5""")
def _(spark, sf):
    a = frozen(spark, sf).where("is_alert").withColumn("total_score", F.round("total_score", 9))
    return reports.top_alerts(a).select("wallet", "rank", "seq", "side", *rnd("total_score", digits=5), F.array_join("detectors", ",").alias("detectors"))


@query("wallet_parts", """WITH b AS (SELECT wallet, sum(total_buy_notional) AS bought FROM wstats GROUP BY 1),
p AS (SELECT wallet, count(*) FILTER (abs(n)>1e-9) AS open_positions, sum(greatest(n,0)) AS long_shares FROM (SELECT wallet, market_id, outcome_index, sum(CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) AS n FROM tape GROUP BY 1,2,3) GROUP BY 1),
e AS (SELECT from_address AS wallet, 'out' AS way, to_address AS other, sum(value_usdc) AS amount FROM transfers GROUP BY 1,2,3 UNION ALL SELECT to_address, 'in', from_address, sum(value_usdc) FROM transfers GROUP BY 1,2,3),
w AS (SELECT wallet, sum(amount) FILTER (way='out') AS top_sent, sum(amount) FILTER (way='in') AS top_received FROM (SELECT *, row_number() OVER (PARTITION BY wallet, way ORDER BY amount DESC, other) AS rn FROM e) WHERE rn<=5 GROUP BY 1),
c AS (SELECT node AS wallet, count(*) AS clusters, max(size) AS largest_cluster FROM member JOIN cmeta USING (market_id, community) GROUP BY 1)
SELECT wallet, round(bought,2) AS bought, open_positions, round(long_shares,2) AS long_shares, round(top_sent,2) AS top_sent, round(top_received,2) AS top_received, coalesce(clusters,0) AS clusters, largest_cluster
FROM b LEFT JOIN p USING (wallet) LEFT JOIN w USING (wallet) LEFT JOIN c USING (wallet)""")
def _(spark, sf):
    s, m = frozen(spark, sf), member(spark, sf)
    meta = m.groupBy("market_id", "community").agg(F.count(F.lit(1)).alias("size"))
    return rounded(reports.wallet_parts(sinks.wallet_market_stats(s, s.where("is_alert")), sinks.wallet_outcome_positions(tape(spark, sf)), tables.transfers(spark, sf), m, meta), 2)


@query("transfer_edges", "SELECT from_address, to_address, round(sum(value_usdc),2) AS amount, count(*) AS tx_count, min(timestamp_s) AS first_ts, max(timestamp_s) AS last_ts FROM transfers GROUP BY 1,2")
def _(spark, sf):
    return rounded(reports.transfer_edges(tables.transfers(spark, sf)), 2)


@query("transfer_hashes", "SELECT DISTINCT from_address, to_address, tx_hash FROM transfers")
def _(spark, sf):
    return reports.transfer_hashes(tables.transfers(spark, sf))


@query("attribution_summary", "SELECT count(*) AS edges, count(DISTINCT from_address) AS senders, count(DISTINCT to_address) AS receivers, round(sum(a),2) AS total_amount, CAST(sum(n) AS BIGINT) AS total_transfers, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus='F') AS complete, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus<>'F') AS incomplete FROM (SELECT from_address, to_address, sum(value_usdc) AS a, count(*) AS n FROM transfers GROUP BY 1,2)")
def _(spark, sf):
    o = tables.read(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status")).distinct()
    return rounded(reports.attribution_summary(reports.transfer_edges(tables.transfers(spark, sf)), o), 2)


@query("wallet_transfers", "SELECT wallet, way, other, rank, round(amount,2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY wallet, way ORDER BY amount DESC, other) AS rank FROM (SELECT from_address AS wallet, 'out' AS way, to_address AS other, sum(value_usdc) AS amount FROM transfers GROUP BY 1,2,3 UNION ALL SELECT to_address, 'in', from_address, sum(value_usdc) FROM transfers GROUP BY 1,2,3)) WHERE rank<=10")
def _(spark, sf):
    return rounded(reports.wallet_transfers(tables.transfers(spark, sf)), 2)


LEGS = "(SELECT seq, market_id, usd_amount, \"timestamp\", maker AS wallet FROM fills UNION ALL SELECT seq, market_id, usd_amount, \"timestamp\", taker FROM fills)"


@query("wallets_by_cutoff", f"SELECT CAST(c AS DOUBLE) AS cutoff, count(*) AS total_wallets, count_if(m>=c) AS wallets FROM (SELECT wallet, max(usd_amount) AS m FROM {LEGS} GROUP BY 1), (SELECT unnest([1000.0,20000.0,30000.0]) AS c) k GROUP BY 1")
def _(spark, sf):
    c = spark.createDataFrame([(1000.0,), (20000.0,), (30000.0,)], "cutoff double")
    return reports.wallets_by_cutoff(reports.legs(tables.fills(spark, sf)), c)


@query("wallet_universe", f"SELECT wallet, min(\"timestamp\") AS first_ts, max(\"timestamp\") AS last_ts, round(max(usd_amount),4) AS max_notional FROM {LEGS} GROUP BY 1")
def _(spark, sf):
    return rounded(reports.wallet_universe(reports.legs(tables.fills(spark, sf))), 4)


@query("participation_counts", "SELECT market_id, wallet, count(*) AS n FROM (SELECT DISTINCT seq, market_id, wallet FROM (SELECT seq, market_id, maker AS wallet FROM fills UNION ALL SELECT seq, market_id, taker FROM fills)) WHERE wallet IN (SELECT DISTINCT from_address FROM transfers) GROUP BY 1,2")
def _(spark, sf):
    w = tables.transfers(spark, sf).select(F.col("from_address").alias("wallet")).distinct()
    return reports.participation_counts(tables.fills(spark, sf), w)


@query("maker_trade_counts", "SELECT market_id, maker AS wallet, count(*) AS n FROM fills GROUP BY 1,2")
def _(spark, sf):
    return tables.fills(spark, sf).groupBy("market_id", F.col("maker").alias("wallet")).agg(F.count(F.lit(1)).alias("n"))


@query("alert_rate_by_market", "SELECT market_id, count(*) AS trades, count_if(is_alert) AS alerts, round(count_if(is_alert)/count(*),6) AS alert_rate FROM scored GROUP BY 1")
def _(spark, sf):
    return scored(spark, sf).groupBy("market_id").agg(F.count(F.lit(1)).alias("trades"), F.count_if("is_alert").alias("alerts"),
                                                     F.round(F.count_if("is_alert") / F.count(F.lit(1)), 6).alias("alert_rate"))


@query("score_distribution", "WITH s AS (SELECT round(total_score,9) AS x FROM scored WHERE total_score>0), l AS (SELECT min(x) AS lo, max(x) AS hi FROM s), h AS (SELECT least(49,CAST(floor((x-lo)/((hi-lo)/50)) AS BIGINT)) AS bin, count(*) AS n FROM s, l GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin)/sum(n) OVER (),6) AS cdf FROM h")
def _(spark, sf):
    return rounded(reports.score_histogram(frozen(spark, sf).withColumn("total_score", F.round("total_score", 9))))


@query("detector_combinations", "SELECT string_agg(d,', ' ORDER BY d) AS detectors, CAST(len(list(d)) AS INTEGER) AS num_detectors, n FROM (SELECT flag_list, n, unnest(flag_list) AS d FROM (SELECT flag_list, count(*) AS n FROM (SELECT list_filter([CASE WHEN conf_volume_anomaly>0 THEN 'volume_anomaly' END, CASE WHEN conf_probability_impact>0 THEN 'probability_impact' END, CASE WHEN conf_accumulation>0 THEN 'accumulation' END, CASE WHEN conf_extreme_position>0 THEN 'extreme_position' END, CASE WHEN conf_contra_silence>0 THEN 'contra_silence' END], lambda x: x IS NOT NULL) AS flag_list FROM alerts) GROUP BY 1)) GROUP BY flag_list, n ORDER BY n DESC, 1 LIMIT 20")
def _(spark, sf):
    return reports.detector_combinations(frozen(spark, sf))


@query("rank_flagged_wallets", "SELECT wallet, count(*) AS alert_count, round(avg(total_score),5) AS avg_score, count(DISTINCT market_id) AS markets_affected, round(sum(notional_usdc),2) AS total_notional, round(count(*)*0.4+avg(total_score)*9+count(DISTINCT market_id)*1.5,5) AS rank_score FROM alerts GROUP BY 1 ORDER BY count(*)*0.4+avg(total_score)*9+count(DISTINCT market_id)*1.5 DESC, 1 LIMIT 50")
def _(spark, sf):
    df = reports.rank_flagged_wallets(frozen(spark, sf)).drop("detectors")
    return rounded(rounded(df, 2, ("avg_score", "rank_score")), 5)


@query("compare_configs", "SELECT config, count(*) AS total_trades, count_if(s>=t) AS total_alerts, round(count_if(s>=t)/count(*),6) AS alert_rate, count(DISTINCT market_id) AS markets_tested, count_if(conf_volume_anomaly>0) AS volume_anomaly_fires, count_if(conf_probability_impact>0) AS probability_impact_fires, count_if(conf_accumulation>0) AS accumulation_fires, count_if(conf_extreme_position>0) AS extreme_position_fires, count_if(conf_contra_silence>0) AS contra_silence_fires FROM (SELECT *, total_score AS s FROM scored), (SELECT unnest(['strict','loose']) AS config, unnest([0.6,0.4]) AS t) c GROUP BY 1")
def _(spark, sf):
    c = spark.createDataFrame([("strict", 0.6), ("loose", 0.4)], "config string, threshold double")
    s = frozen(spark, sf).crossJoin(F.broadcast(c)).withColumn("is_alert", F.col("total_score") >= F.col("threshold"))
    return rounded(reports.compare_configs(s))


# ---- set operations ---------------------------------------------------------
@query("union_all", f"SELECT wallet, count(*) AS n FROM {LEGS} GROUP BY 1")
def _(spark, sf):
    return reports.legs(tables.fills(spark, sf)).groupBy("wallet").agg(F.count(F.lit(1)).alias("n"))


@query("union_distinct", f"SELECT DISTINCT wallet FROM {LEGS}")
def _(spark, sf):
    return reports.legs(tables.fills(spark, sf)).select("wallet").distinct()


@query("concat_tapes", "SELECT market_id, count(*)*2 AS n, count(DISTINCT seq) AS trades FROM tape GROUP BY 1")
def _(spark, sf):
    t = tape(spark, sf)
    return t.unionByName(t).groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("trades"))


@query("wallet_set_ops", "SELECT market_id, wallet, CASE WHEN predicted THEN 'both' ELSE 'missed' END AS grp FROM evals WHERE is_insider")
def _(spark, sf):
    e = evaluations(spark, sf)
    flagged = e.where("flag_rate >= 0.5").select("market_id", "wallet")
    insiders = e.where("is_insider").select("market_id", "wallet")
    return flagged.intersect(insiders).withColumn("grp", F.lit("both")).unionByName(insiders.subtract(flagged).withColumn("grp", F.lit("missed")))


@query("winner_resolution", "SELECT market_id, CASE WHEN market_id % 7=0 THEN 1 WHEN market_id % 5=0 THEN 0 ELSE w.winner END AS winner FROM markets LEFT JOIN winners w USING (market_id) WHERE market_id % 7=0 OR market_id % 5=0 OR w.winner IS NOT NULL")
def _(spark, sf):
    m = tables.markets(spark, sf)
    case = m.where("market_id % 7 = 0").select("market_id", F.lit(1).alias("winner"))
    override = m.where("market_id % 5 = 0").select("market_id", F.lit(0).alias("winner"))
    return labels.winner_precedence(case, override, winners(spark, sf))


@query("tumbling_volume", "SELECT market_id, outcome_index, side, timestamp_ms//300000*300000 AS bucket_ms, count(*) AS n, round(sum(notional_usdc),4) AS volume FROM tape GROUP BY 1,2,3,4")
def _(spark, sf):
    t = tape(spark, sf).withColumn("ts", F.timestamp_millis("timestamp_ms"))
    df = t.groupBy("market_id", "outcome_index", "side", F.window("ts", "300 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("notional_usdc"), 4).alias("volume"))
    return df.select("market_id", "outcome_index", "side", F.unix_millis("w.start").alias("bucket_ms"), "n", "volume")
