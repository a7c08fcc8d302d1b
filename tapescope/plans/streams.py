"""Queries that run the tables through the streaming feeds, in several micro-batches."""

import uuid

from pyspark.sql import functions as F

from tapescope.operators import causal, graph
from tapescope.plans.base import CFG, replay_views, rnd, tape
from tapescope.plans.books import changes
from tapescope.plans.evaluate import rounded
from tapescope.plans.ingest import raw_trades
from tapescope.plans.registry import query, view
from tapescope.session import checkpoint_dir, cut
from tapescope.sources import tables
from tapescope.streaming import books, feeds, live

SLICES, DAY_MS = 4, 86_400_000


def landed(spark, lines, after=None):
    """Write lines (value, at: day since 1970) where a stream reads, one file a slice of time, oldest first; ``after`` (folder) runs after every second one."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    part = F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor((F.col("at") - tables.BOOK_DAY) * SLICES / (tables.BOOK_DAYS + 1))))
    lines = cut(lines.withColumn("_part", F.coalesce(part, F.lit(0))))
    for k in range(SLICES):
        lines.where(F.col("_part") == k).select("value").coalesce(1).write.mode("append").text(f"{base}/in")
        if after and k % 2:
            after(base)
    return base


def landed_trades(spark, sf, after=None):
    """The raw records, every one sent twice."""
    raw = raw_trades(spark, sf)
    at = F.get_json_object("value", "$.timestamp").try_cast("double") / 86_400
    return landed(spark, raw.unionByName(raw).withColumn("at", at), after)


def deduped(spark, base):
    return feeds.dedup(feeds.trade_stream(spark, f"{base}/in", 1))


def to_parquet(stream, base, name="out"):
    q = stream.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/{name}")


@query("trade_stream", "SELECT wallet, count(*)*2 AS n FROM tape GROUP BY 1")
def _(spark, sf):
    base = landed_trades(spark, sf)
    return to_parquet(feeds.trade_stream(spark, f"{base}/in", 1).select("wallet", "tx_hash"), base).groupBy("wallet").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedup", "SELECT wallet, count(*) AS n FROM tape GROUP BY 1")
def _(spark, sf):
    base = landed_trades(spark, sf)
    return to_parquet(deduped(spark, base).select("wallet", "tx_hash"), base).groupBy("wallet").agg(F.count(F.lit(1)).alias("n"))


# ---- the feed's times are whole seconds: the same views on such a tape
replay_views("_s", "SELECT * REPLACE (timestamp_ms//1000*1000 AS timestamp_ms) FROM tape")
_n = CFG["new_wallet"]
view("live_base", f"""SELECT s.*, 1-(1-base_score)*(1-CASE WHEN s.notional_usdc>={_n['min_notional']} AND s.timestamp_ms-f.first<{_n['max_age_minutes'] * 60_000} THEN {_n['max_confidence']} ELSE 0 END) AS live_score,
 row_number() OVER (PARTITION BY s.market_id, s.wallet ORDER BY s.timestamp_ms, s.seq) AS rn
FROM scored_s s JOIN (SELECT wallet, min(timestamp_ms) AS first FROM tape_s GROUP BY 1) f USING (wallet)""")
#: Earlier alerts raise the score; the boost of the wallet is 1 + (market % 3) / 10, for every other market none.
LIVE_SQL = """
WITH RECURSIVE lifted AS (SELECT *, CASE WHEN market_id % 2=0 THEN CAST(CAST(1.0+(market_id % 3)/10.0 AS FLOAT) AS DOUBLE) END AS m FROM live_base),
step AS (
 SELECT market_id, wallet, rn, seq, 0 AS before, least(live_score*coalesce(m,1),CASE WHEN m IS NULL THEN 1 ELSE 0.95 END) AS s FROM lifted WHERE rn=1
 UNION ALL
 SELECT market_id, wallet, rn, seq, before, least(u*coalesce(m,1),CASE WHEN m IS NULL THEN 1 ELSE 0.95 END) FROM (
  SELECT r.market_id, r.wallet, r.rn, r.seq, r.m, p.before+CAST(p.s>=0.5 AS INTEGER) AS before,
   1-(1-r.live_score)*(1-CASE WHEN p.before+CAST(p.s>=0.5 AS INTEGER)>=1 THEN round(0.8/(1+exp(-0.7*(p.before+CAST(p.s>=0.5 AS INTEGER)-5))),4) ELSE 0 END) AS u
  FROM step p JOIN lifted r ON r.market_id=p.market_id AND r.wallet=p.wallet AND r.rn=p.rn+1)),
live AS (SELECT t.*, before AS prior_flags, s AS total_score, s>=0.5 AS is_alert FROM step JOIN tape_s t USING (seq))
"""


_STORES: dict[tuple[str, str], str] = {}


def processed(spark, sf):
    """The live job over all slices, once for the queries of an application; a table of boosts stands for the periodic jobs' latest."""
    store = lambda base: feeds.TradeStore(spark, f"{base}/store")
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        pairs = tape(spark, sf).where("market_id % 2 = 0").select("market_id", "wallet").distinct()
        boosts = cut(pairs.select(F.col("market_id").cast("long").alias("market_id"), "wallet", (1.0 + F.col("market_id") % 3 / 10.0).alias("multiplier")))
        _STORES[key] = landed_trades(spark, sf, lambda base: live.advance(feeds.as_tape(deduped(spark, base)), CFG, f"{base}/live", live.writer(store(base), CFG), boosts))
    return store(_STORES[key])


@query("stream_detect", LIVE_SQL + "SELECT market_id, seq, prior_flags, round(total_score,6) AS total_score, is_alert FROM live")
def _(spark, sf):
    return processed(spark, sf).get("scores").select("market_id", "seq", "prior_flags", *rnd("total_score"), "is_alert")


@query("stream_upserts", LIVE_SQL + """SELECT wallet, market_id, outcome_index, count(*) AS trade_count, round(sum(CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END),3) AS net_shares,
 round(sum(CASE WHEN side='BUY' THEN notional_usdc ELSE -notional_usdc END),2) AS net_cost, any_value(flags) AS flag_count FROM (
 SELECT *, count(*) FILTER (is_alert) OVER (PARTITION BY market_id, wallet) AS flags FROM live) GROUP BY 1,2,3""")
def _(spark, sf):
    """Positions, with the alerts of the wallet in the market, from the deltas of all batches."""
    store = processed(spark, sf)
    flags = feeds.wallet_stats(store).select("market_id", "wallet", "flag_count")
    return live.positions(store).join(flags, ["market_id", "wallet"]).select(
        "wallet", "market_id", "outcome_index", "trade_count", *rnd("net_shares", digits=3), *rnd("net_cost", digits=2), "flag_count")


@query("stream_alerts", LIVE_SQL + """SELECT seq, round(live.total_score,6) AS total_score, array_to_string(list_filter([CASE WHEN conf_volume_anomaly>0 THEN 'volume_anomaly' END,
 CASE WHEN conf_probability_impact>0 THEN 'probability_impact' END, CASE WHEN conf_accumulation>0 THEN 'accumulation' END, CASE WHEN conf_extreme_position>0 THEN 'extreme_position' END,
 CASE WHEN conf_contra_silence>0 THEN 'contra_silence' END, CASE WHEN b.live_score>b.base_score+1e-12 THEN 'new_wallet' END, CASE WHEN prior_flags>=1 THEN 'recidivism' END], lambda x: x IS NOT NULL),',') AS detectors
FROM live JOIN live_base b USING (seq) WHERE live.is_alert""")
def _(spark, sf):
    df = live.alerts(processed(spark, sf))
    return df.select("seq", *rnd("total_score"), F.array_join("detectors", ",").alias("detectors"))


@query("stream_new_wallet", "SELECT seq, wallet FROM (SELECT seq, wallet, notional_usdc, timestamp_ms//1000*1000 AS t, min(timestamp_ms//1000*1000) OVER (PARTITION BY wallet) AS f FROM tape) WHERE round(notional_usdc,6)>=1000 AND t-f<3600000")
def _(spark, sf):
    return processed(spark, sf).get("scores").where("conf_new_wallet > 0").select("seq", "wallet")


# ---- gates of the periodic jobs, on the default clocks
_J, _K = CFG["jumps"], CFG["clustering"]
POLL, EVERY = int(_J["poll_interval_seconds"] * 1000), int(_J["scoring_interval_minutes"] * 60_000)
#: Batches, those whose scoring falls due, and the large trades at which clusters do; the last batch of a market is still open.
GATES_SQL = f"""
WITH RECURSIVE m AS (SELECT DISTINCT market_id, timestamp_ms FROM tape_s),
succ AS (SELECT market_id, timestamp_ms, min(timestamp_ms) OVER (PARTITION BY market_id ORDER BY timestamp_ms RANGE BETWEEN {POLL} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM m),
starts AS (SELECT market_id, min(timestamp_ms) AS start_ms FROM m GROUP BY 1 UNION ALL SELECT s.market_id, nxt FROM starts s JOIN succ u ON u.market_id=s.market_id AND u.timestamp_ms=s.start_ms WHERE nxt IS NOT NULL),
batches AS (SELECT market_id, start_ms, max(timestamp_ms) AS end_ms FROM (SELECT m.market_id, m.timestamp_ms, max(start_ms) OVER (PARTITION BY m.market_id ORDER BY m.timestamp_ms) AS start_ms
 FROM m LEFT JOIN starts s ON s.market_id=m.market_id AND s.start_ms=m.timestamp_ms) GROUP BY 1,2),
nextdue AS (SELECT market_id, end_ms, min(end_ms) OVER (PARTITION BY market_id ORDER BY end_ms RANGE BETWEEN {EVERY} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM batches),
due AS (SELECT market_id, min(end_ms) AS end_ms FROM batches GROUP BY 1 UNION ALL SELECT d.market_id, nxt FROM due d JOIN nextdue n ON n.market_id=d.market_id AND n.end_ms=d.end_ms WHERE nxt IS NOT NULL),
big AS (SELECT market_id, seq, timestamp_ms//1000 AS t, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_ms, seq) AS pos FROM tape_s WHERE notional_usdc>={_K['min_trade_size']}),
tick AS (SELECT market_id, CAST(0 AS BIGINT) AS pos, min(timestamp_ms)//1000 AS t FROM tape_s GROUP BY 1
 UNION ALL SELECT k.market_id, n.pos, n.t FROM tick k, LATERAL (SELECT pos, t FROM big b WHERE b.market_id=k.market_id AND b.pos>k.pos AND b.t-k.t>={_K['min_cluster_interval']}
  AND (b.t-k.t>={_K['max_cluster_interval']} OR b.pos-k.pos>={_K['significant_change_threshold']}) ORDER BY pos LIMIT 1) n)
"""


def ticked(spark, sf):
    base = landed_trades(spark, sf)
    return to_parquet(live.gates(feeds.as_tape(deduped(spark, base)), CFG), base)


@query("stream_jump_ticks", GATES_SQL + "SELECT market_id, end_ms AS tick_ms FROM due WHERE end_ms<(SELECT max(end_ms) FROM batches b WHERE b.market_id=due.market_id)")
def _(spark, sf):
    return ticked(spark, sf).where("scored_ms is not null").select(F.col("market_id").cast("int").alias("market_id"), F.col("scored_ms").alias("tick_ms"))


@query("stream_recluster_ticks", GATES_SQL + "SELECT tick.market_id, seq FROM tick JOIN big USING (market_id, pos)")
def _(spark, sf):
    return ticked(spark, sf).where("recluster").select(F.col("market_id").cast("int").alias("market_id"), "seq")


def gated(spark, sf):
    """(ticks, trades) of the feed: its records are cleaned and stored once, and the gates read what the store has got."""
    got = []

    def after(base):
        trades = to_parquet(feeds.as_tape(deduped(spark, base)), base, "trades")
        got[:] = to_parquet(live.gates(spark.readStream.schema(trades.schema).parquet(f"{base}/trades"), CFG), base, "ticks"), trades

    landed_trades(spark, sf, after)
    return got


@query("stream_jump_rescore")
def _(spark, sf):
    """Boosts at the ticks that the gate let through, each over the day before it."""
    ticks, stored = gated(spark, sf)
    ticks = ticks.where("scored_ms is not null").select("market_id", F.col("scored_ms").alias("tick"), F.col("scored_ms").alias("tick_ms"))
    return rounded(causal.tick_boosts(stored, ticks, CFG))


@query("stream_recluster")
def _(spark, sf):
    """Clusters as of each market's last tick."""
    ticks, trades = gated(spark, sf)
    last = ticks.where("recluster").groupBy("market_id").agg(F.max(F.struct("timestamp_ms", "seq")).alias("_last"))
    known = trades.join(last, "market_id").where(F.struct("timestamp_ms", "seq") <= F.col("_last"))
    member, meta = graph.clusters(graph.large_trades(known, CFG), CFG)
    return rounded(graph.wallet_boosts(member, meta))


# ---- books
@query("book_stream", """SELECT t.seq, t.asset_id, d.book_ms, round(CASE WHEN c.timestamp_ms>=coalesce(d.book_ms,0) THEN c.best_bid ELSE d.best_bid END,6) AS best_bid,
 round(CASE WHEN c.timestamp_ms>=coalesce(d.book_ms,0) THEN c.best_ask ELSE d.best_ask END,6) AS best_ask,
 round(CASE WHEN c.timestamp_ms>=coalesce(d.book_ms,0) THEN coalesce(d.best_bid_size,0) WHEN d.best_bid IS NOT NULL THEN d.best_bid_size END,4) AS best_bid_size
FROM (SELECT *, market_id*2+outcome_index AS asset_id FROM tape) t ASOF LEFT JOIN depths d ON t.asset_id=d.asset_id AND t.timestamp_ms>=d.book_ms
 ASOF LEFT JOIN book_changes c ON t.asset_id=c.asset_id AND t.timestamp_ms>=c.timestamp_ms""")
def _(spark, sf):
    """Every trade with the book as of its time; snapshots, of which every third comes twice, and changes arrive in several batches."""
    text = lambda side: F.transform(side, lambda lv: F.struct(lv["price"].cast("string").alias("price"), lv["size"].cast("string").alias("size")))
    day = lambda t: F.col(t) / DAY_MS
    b = tables.books(spark, sf)
    sent = b.unionByName(b.where("asset_id % 3 = 0")).select(F.to_json(F.array(F.struct(F.col("asset_id").cast("string").alias("asset_id"), F.col("timestamp_ms").cast("string").alias("timestamp"),
                                                                                         text("bids").alias("bids"), text("asks").alias("asks")))).alias("value"), day("timestamp_ms").alias("at"))
    moved = changes(spark, sf).select(F.to_json(F.struct(F.lit("price_change").alias("event_type"), F.col("timestamp_ms").cast("string").alias("timestamp"), F.array(F.struct(
        F.col("asset_id").cast("string").alias("asset_id"), *[F.col(c).cast("string").alias(c) for c in ("best_bid", "best_ask")])).alias("price_changes"))).alias("value"), day("timestamp_ms").alias("at"))
    asked = tape(spark, sf).select(F.to_json(F.struct(F.lit("trade").alias("event_type"), (F.col("market_id") * 2 + F.col("outcome_index")).cast("string").alias("asset_id"),
                                                      "seq", "timestamp_ms")).alias("value"), day("timestamp_ms").alias("at"))
    base = landed(spark, sent.unionByName(moved).unionByName(asked))
    raw = spark.readStream.schema("value string").format("text").option("maxFilesPerTrigger", 1).load(f"{base}/in")
    trades = raw.select(F.from_json("value", "event_type string, asset_id string, seq long, timestamp_ms long").alias("t")).select("t.*").where("event_type = 'trade'")
    found = to_parquet(books.book_lookup(books.parse_book_messages(raw), trades, "1 hour", 3_600_000, 60 * DAY_MS), base)
    top = lambda side, field: F.get(side, F.lit(0))[field]
    return found.select("seq", F.col("asset_id").cast("int").alias("asset_id"), "book_ms", F.round(top("bids", "price"), 6).alias("best_bid"),
                        F.round(top("asks", "price"), 6).alias("best_ask"), F.round(top("bids", "size"), 4).alias("best_bid_size"))
