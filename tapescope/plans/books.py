"""Queries over order books, book detectors and wallet age."""

from pyspark.sql import functions as F

from tapescope.config import make_config
from tapescope.operators import books, detectors, markets
from tapescope.plans.base import CFG, rnd, tape
from tapescope.plans.registry import query, view
from tapescope.sources import tables

view("depths", """SELECT asset_id, book_ms, coalesce(sum(size) FILTER (is_bid),0) AS bid, coalesce(sum(size) FILTER (NOT is_bid),0) AS ask,
 max(price) FILTER (is_bid) AS best_bid, min(price) FILTER (NOT is_bid) AS best_ask, coalesce(arg_max(size, price) FILTER (is_bid),0) AS best_bid_size,
 coalesce(sum(size) FILTER (is_bid AND price>=0.45),0) AS bid_near, coalesce(sum(size) FILTER (NOT is_bid AND price<=0.55),0) AS ask_near FROM book_levels GROUP BY 1,2""")
# one unit of the tables' books stands for 100 tokens, so that trades and depth are comparable
SCALE = 0.01
CFG_BOOK = make_config(thin_liquidity={"max_total_depth": 2_000.0, "min_depth_ratio": 0.05}, orderbook_imbalance={"min_imbalance_ratio": 1.1})
# the latest snapshot at or before the trade
view("tape_book", f"""SELECT t.*, d.book_ms, bid, ask, best_bid, best_ask, best_bid_size FROM (SELECT *, market_id*2+outcome_index AS asset_id, size_tokens*{SCALE} AS sz FROM tape) t
 ASOF JOIN depths d ON t.asset_id=d.asset_id AND t.timestamp_ms>=d.book_ms""")


def with_books(spark, sf):
    return markets.book_asof(tape(spark, sf).withColumn("size_tokens", F.col("size_tokens") * SCALE), tables.books(spark, sf))


@query("book_metrics", """SELECT asset_id, book_ms AS timestamp_ms, round(bid,4) AS bid_depth, round(ask,4) AS ask_depth,
 round(CASE WHEN ask>0 THEN bid/ask WHEN bid>0 THEN 'inf'::DOUBLE ELSE 1.0 END,6) AS imbalance, round((best_ask-best_bid)/((best_bid+best_ask)/2)*10000,4) AS spread_bps,
 round(bid_near,4) AS bid_depth_bounded, round(ask_near,4) AS ask_depth_bounded FROM depths""")
def _(spark, sf):
    df = detectors.book_metrics(tables.books(spark, sf), 0.45, 0.55)
    return df.select("asset_id", "timestamp_ms", *rnd("bid_depth", "ask_depth", digits=4), *rnd("imbalance"), *rnd("spread_bps", "bid_depth_bounded", "ask_depth_bounded", digits=4))


@query("book_asof_join", """SELECT seq, asset_id, book_ms, n_bids FROM tape_book JOIN
 (SELECT asset_id, book_ms, count(*) FILTER (is_bid) AS n_bids FROM book_levels GROUP BY 1,2) USING (asset_id, book_ms)""")
def _(spark, sf):
    return with_books(spark, sf).where("bids is not null").select("seq", "asset_id", "book_ms", F.size("bids").cast("long").alias("n_bids"))


_OC, _OI, _TL = CFG_BOOK["orderbook_consumption"], CFG_BOOK["orderbook_imbalance"], CFG_BOOK["thin_liquidity"]


@query("orderbook_consumption", f"""
WITH l AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY asset_id, book_ms, is_bid ORDER BY CASE WHEN is_bid THEN -price ELSE price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM book_levels),
w AS (SELECT seq, any_value(notional_usdc) AS nu, count_if(before<sz) AS n, sum(l.price*greatest(0,least(size,sz-before))) AS cost, sum(greatest(0,least(size,sz-before))) AS got, CASE WHEN any_value(side)='BUY' THEN min(l.price) ELSE max(l.price) END AS best
 FROM tape_book t JOIN l ON l.asset_id=t.asset_id AND l.book_ms=t.book_ms AND l.is_bid=(side='SELL') GROUP BY 1)
SELECT seq, round((0.5*least(1.0,n/10.0)+0.5*least(1.0,abs((cost/got-best)/best)*10000/{_OC['max_slippage_bps']}))*{_OC['max_confidence']},5) AS confidence
FROM w WHERE nu>={_OC['min_notional']} AND n>={_OC['min_levels_consumed']} AND got>0""")
def _(spark, sf):
    df = detectors.with_fill(with_books(spark, sf))
    return df.select("seq", F.round(detectors.orderbook_consumption(CFG_BOOK), 5).alias("confidence")).where("confidence > 0")


@query("orderbook_imbalance", f"""SELECT seq, round((0.6*least(1.0,part)+0.4*least(1.0,notional_usdc/3000))*{_OI['max_confidence']},5) AS confidence FROM (
 SELECT *, CASE WHEN side='SELL' THEN CASE WHEN ask=0 THEN 1.0 ELSE bid/ask/{2 * _OI['min_imbalance_ratio']} END ELSE CASE WHEN bid=0 THEN 1.0 ELSE ask/bid/{2 * _OI['min_imbalance_ratio']} END END AS part FROM tape_book
 WHERE notional_usdc>={_OI['min_notional']} AND ((side='SELL' AND (ask=0 OR bid/ask>{_OI['min_imbalance_ratio']})) OR (side='BUY' AND ask>0 AND bid/ask<1/CAST({_OI['min_imbalance_ratio']} AS DOUBLE))))""")
def _(spark, sf):
    return with_books(spark, sf).select("seq", F.round(detectors.orderbook_imbalance(CFG_BOOK), 5).alias("confidence")).where("confidence > 0")


@query("thin_liquidity", f"""SELECT seq, round((0.5*(1-(bid+ask)/{_TL['max_total_depth']})+0.5*least(1.0,sz/side_depth/0.5))*{_TL['max_confidence']},4) AS confidence
FROM (SELECT *, CASE WHEN side='BUY' THEN ask ELSE bid END AS side_depth FROM tape_book)
WHERE notional_usdc>={_TL['min_notional']} AND bid+ask<{_TL['max_total_depth']} AND side_depth>0 AND sz/side_depth>={_TL['min_depth_ratio']}""")
def _(spark, sf):
    return with_books(spark, sf).select("seq", F.round(detectors.thin_liquidity(CFG_BOOK), 4).alias("confidence")).where("confidence > 0")


@query("new_wallet", "SELECT seq, 0.4 AS confidence FROM tape JOIN (SELECT wallet, min(timestamp_ms) AS f FROM tape GROUP BY 1) USING (wallet) WHERE notional_usdc>=1000 AND timestamp_ms-f<3600000".replace("0.4 AS", "CAST(0.4 AS DOUBLE) AS"))
def _(spark, sf):
    t = tape(spark, sf)
    df = t.join(books.wallet_first_seen(t), "wallet", "left")
    return df.select("seq", detectors.new_wallet(CFG).alias("confidence")).where("confidence > 0")


# every third trade of an asset moves its best prices
view("book_changes", "SELECT market_id*2+outcome_index AS asset_id, timestamp_ms, seq, round(price-0.005,6) AS best_bid, round(price+0.005,6) AS best_ask FROM tape WHERE seq % 3=0")


@query("book_states", """SELECT c.seq, c.asset_id, c.best_bid, c.best_ask, round(coalesce(d.best_bid_size,0),4) AS best_bid_size
FROM book_changes c ASOF LEFT JOIN depths d ON c.asset_id=d.asset_id AND c.timestamp_ms>=d.book_ms""")
def _(spark, sf):
    snaps = tables.books(spark, sf).select("asset_id", "timestamp_ms", F.lit(-1).cast("long").alias("seq"), F.lit("snapshot").alias("kind"), "bids", "asks")
    s = books.book_states(snaps.unionByName(changes(spark, sf), allowMissingColumns=True)).where("kind = 'change'")
    top = F.get("bids", F.lit(0))
    return s.select("seq", "asset_id", F.round(top["price"], 6).alias("best_bid"), F.round(F.get("asks", F.lit(0))["price"], 6).alias("best_ask"), F.round(top["size"], 4).alias("best_bid_size"))


def changes(spark, sf):
    return tape(spark, sf).where("seq % 3 = 0").select(
        (F.col("market_id") * 2 + F.col("outcome_index")).alias("asset_id"), "timestamp_ms", "seq", F.lit("change").alias("kind"),
        F.round(F.col("price") - 0.005, 6).alias("best_bid"), F.round(F.col("price") + 0.005, 6).alias("best_ask"))
