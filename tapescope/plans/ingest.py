"""Queries over readers, normalisers and sinks."""

import uuid

from pyspark.sql import functions as F

from tapescope.operators import labels, scoring
from tapescope.plans.base import CFG, RESOLUTION_THRESHOLD, frozen, rnd, tape, winners
from tapescope.plans.evaluate import r, rounded
from tapescope.plans.registry import query
from tapescope.session import checkpoint_dir
from tapescope.sources import readers, sinks, tables


@query("scan_markets", "SELECT c_nationkey AS id, arg_min(c_name, c_custkey) AS market_slug, arg_min(c_acctbal, c_custkey) AS volume FROM customer GROUP BY 1")
def _(spark, sf):
    raw = tables.read(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("market_slug"), F.col("c_acctbal").alias("volume"), "c_custkey")
    return readers.first_per_key(raw, ["id"], ["c_custkey"]).drop("c_custkey")


@query("scan_fills", """SELECT seq, "timestamp", market_id, maker, taker, nonusdc_side, maker_direction, round(usd_amount,4) AS usd_amount FROM fills
 WHERE usd_amount>=2000 AND "timestamp">='2024-01-05' AND "timestamp"<='2024-01-20T12:00:00'""")
def _(spark, sf):
    df = readers.filter_fills(tables.fills(spark, sf), None, 2000.0, "2024-01-05", "2024-01-20T12:00:00")
    return df.select("seq", "timestamp", "market_id", "maker", "taker", "nonusdc_side", "maker_direction", *rnd("usd_amount", digits=4))


@query("fills_to_trades", "SELECT seq, t.market_id, market_slug, category, wallet, outcome_index, side, round(price,6) AS price, round(notional_usdc,4) AS notional_usdc, timestamp_ms, tx_hash FROM tape t JOIN markets m ON m.market_id=t.market_id")
def _(spark, sf):
    df = readers.fills_to_trades(tables.fills(spark, sf), tables.markets(spark, sf))
    return df.select("seq", "market_id", "market_slug", "category", "wallet", "outcome_index", "side", *rnd("price"), *rnd("notional_usdc", digits=4), "timestamp_ms", "tx_hash")


@query("convert_layout", "SELECT market_id, count(*) AS n, round(sum(usd_amount),2) AS total FROM fills GROUP BY 1")
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/layout-{uuid.uuid4().hex}"
    sinks.convert_layout(tables.fills(spark, sf), path)
    return spark.read.parquet(path).groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("usd_amount"), 2).alias("total"))


@query("parse_timestamps", "SELECT seq, CASE seq % 4 WHEN 0 THEN timestamp_ms//1000*1000 ELSE timestamp_ms END AS parsed_ms FROM tape")
def _(spark, sf):
    t = tape(spark, sf)
    iso = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    kind = F.pmod("seq", F.lit(4))
    text = F.when(kind == 0, F.floor(F.col("timestamp_ms") / 1000).cast("string")).when(kind == 1, F.col("timestamp_ms").cast("string")).when(
        kind == 2, F.concat(iso, F.lit("Z"))).otherwise(iso)
    return t.select("seq", readers.epoch_ms(text).alias("parsed_ms"))


def raw_trades(spark, sf):
    """Every trade as an API record, some with numbers as text, and broken records next to them."""
    t = tape(spark, sf)
    stamp = F.floor(F.col("timestamp_ms") / 1000)
    common = [F.col("wallet").alias("proxyWallet"), F.col("market_id").cast("string").alias("conditionId"), "side"]
    rest = [F.col("tx_hash").alias("transactionHash"), (F.col("market_id") * 2 + F.col("outcome_index")).cast("string").alias("asset")]
    numbers = {"outcomeIndex": F.col("outcome_index"), "size": F.col("size_tokens"), "price": F.col("price"), "timestamp": stamp}
    plain = F.to_json(F.struct(*common, *[c.alias(n) for n, c in numbers.items()], *rest))
    text = F.to_json(F.struct(*common, *[c.cast("string").alias(n) for n, c in numbers.items()], *rest))
    kind = F.pmod("seq", F.lit(97))
    trades = t.select(F.when(kind == 2, text).otherwise(plain).alias("value"))
    broken = t.where(kind < 2).select(F.when(kind == 0, F.lit("{broken")).otherwise(F.lit('{"proxyWallet":"0x1","price":"x"}')).alias("value"))
    return trades.unionByName(broken)


@query("parse_trade_json", "SELECT tx_hash, wallet, CAST(market_id AS VARCHAR) AS condition_id, side, outcome_index, round(price,6) AS price, round(notional_usdc,3) AS notional_usdc, timestamp_ms//1000*1000 AS timestamp_ms, CAST(market_id*2+outcome_index AS VARCHAR) AS asset FROM tape")
def _(spark, sf):
    return readers.parse_trade_json(raw_trades(spark, sf)).select(
        "tx_hash", "wallet", "condition_id", "side", "outcome_index", *rnd("price"), *rnd("notional_usdc", digits=3), "timestamp_ms", "asset")


@query("parse_market_json", """SELECT p_partkey AS market_id, 't'||(2*p_partkey)||'|t'||(2*p_partkey+1) AS tokens, 2 AS n_outcomes,
 CASE WHEN p_partkey % 2=0 THEN p_name WHEN p_partkey % 3=0 THEN p_brand||' '||p_name ELSE p_brand||': '||p_name END AS question FROM part WHERE p_partkey % 23<>0""")
def _(spark, sf):
    p = tables.read(spark, sf, "part")
    a, b = F.concat(F.lit("t"), (F.col("p_partkey") * 2).cast("string")), F.concat(F.lit("t"), (F.col("p_partkey") * 2 + 1).cast("string"))
    titled = (F.col("p_partkey") % 2 != 0) & (F.col("p_partkey") % 3 == 0)
    raw = p.select(F.col("p_partkey").alias("market_id"),
                   F.when(F.col("p_partkey") % 23 == 0, F.when(F.col("p_partkey") % 2 == 0, "[]").otherwise("")).when(
                       F.col("p_partkey") % 2 == 0, F.to_json(F.array(a, b))).otherwise(F.concat(a, F.lit(", "), b)).alias("token_ids"),
                   F.lit('["Yes","No"]').alias("outcomes"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")).alias("event_title"),
                   F.when(titled, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_name")).alias("question"))
    df = readers.parse_market_json(raw)
    return df.select("market_id", F.concat_ws("|", "token_ids").alias("tokens"), F.size("outcomes").alias("n_outcomes"), "question")


@query("normalize_transfers", "SELECT tx_hash, from_address, to_address, min(timestamp_s) AS timestamp_s, round(min(value_usdc),2) AS value_usdc FROM transfers WHERE CAST(substr(tx_hash,2) AS BIGINT) % 50<>0 GROUP BY 1,2,3")
def _(spark, sf):
    t = tables.transfers(spark, sf)
    num = F.substring("tx_hash", 2, 20).cast("long")
    raw = t.select(F.upper("tx_hash").alias("hash"), F.concat(F.lit(" "), F.upper("from_address")).alias("from"), F.upper("to_address").alias("to"),
                   F.col("timestamp_s").cast("string").alias("timeStamp"), F.lit("1").alias("blockNumber"),
                   F.when(num % 50 == 0, "bad").otherwise((F.col("value_usdc") * 1e6).cast("string")).alias("value"))
    df = readers.normalize_transfers(raw.unionByName(raw))
    return df.select("tx_hash", "from_address", "to_address", "timestamp_s", *rnd("value_usdc", digits=2))


@query("parse_book_snapshot", """SELECT asset_id, book_ms AS timestamp_ms, count(*) FILTER (is_bid) AS n_bids, count(*) FILTER (NOT is_bid) AS n_asks, round(max(price) FILTER (is_bid),4) AS best_bid, round(min(price) FILTER (NOT is_bid),4) AS best_ask
 FROM book_levels GROUP BY 1,2""".replace("FILTER (is_bid)", "FILTER (is_bid AND price<0.495)"))
def _(spark, sf):
    b = tables.books(spark, sf)
    broken = b.withColumn("bids", F.transform("bids", lambda lv: F.struct(lv["price"].alias("price"), F.when(lv["price"] >= 0.495, 0.0).otherwise(lv["size"]).alias("size"))))
    df = readers.parse_book_snapshot(broken)
    return df.select("asset_id", "timestamp_ms", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"),
                     F.round(F.get("bids", F.lit(0))["price"], 4).alias("best_bid"), F.round(F.get("asks", F.lit(0))["price"], 4).alias("best_ask"))


@query("read_resolution_overrides", """SELECT CAST(p_partkey AS BIGINT) AS market_id, CAST(p_partkey % 2 AS INTEGER) AS winner, CASE WHEN p_partkey % 3=1 THEN '2024-02-01' END AS resolution_date,
 CASE WHEN p_partkey % 3=1 THEN p_brand ELSE '' END AS note FROM part WHERE p_partkey % 3<>2""")
def _(spark, sf):
    key, win = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2
    rec = F.to_json(F.struct(win.alias("winning_outcome"), F.lit("2024-02-01").alias("resolution_date"), F.col("p_brand").alias("note")))
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit('{"'), key, F.lit('": '), win.cast("string"), F.lit("}"))).when(
        kind == 1, F.concat(F.lit('{"'), key, F.lit('": '), rec, F.lit("}"))).otherwise(F.concat(F.lit('{"bad'), key, F.lit('": 1}')))
    return readers.read_resolution_overrides(tables.read(spark, sf, "part").select(text.alias("value")))


# categories as the classifier states them; unknown and missing ones make a failed entry
CLS_SQL = """SELECT doc_id AS market_id, CASE WHEN ok THEN cat END AS category, CASE WHEN ok THEN least(1,greatest(0,conf)) ELSE 0 END AS confidence,
 CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, ok AND cat IN ('ELECTION','EARNINGS','POLICY','GEOPOLITICAL','APPOINTMENT','LEGAL','PRODUCT_LAUNCH','OTHER_ANNOUNCEMENT') AS insider_plausible
 FROM (SELECT doc_id, cat, conf, coalesce(cat IN ('ELECTION','EARNINGS','POLICY','GEOPOLITICAL','APPOINTMENT','LEGAL','PRODUCT_LAUNCH','OTHER_ANNOUNCEMENT',
  'CRYPTO_PRICE','SPORTS','WEATHER','ENTERTAINMENT','SCIENCE','GRADUAL','OTHER'), false) AND doc_id % 13<>0 AS ok
 FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ELECTION' WHEN 1 THEN 'SPORTS' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'CRYPTO_PRICE' WHEN 4 THEN 'OTHER_ANNOUNCEMENT' END AS cat,
 CASE WHEN doc_id % 7=0 THEN -1.0 ELSE n_chars/1000.0 END AS conf FROM documents))"""


def classifications(spark, sf):
    d = tables.read(spark, sf, "documents")
    k = F.col("doc_id") % 6
    raw = d.select(F.col("doc_id").alias("market_id"), F.when(k == 0, " election").when(k == 1, "Sports ").when(k == 2, "unknown").when(
        k == 3, "crypto_price").when(k == 4, "other_announcement").alias("category"), F.when(F.col("doc_id") % 13 == 0, "failed").alias("status"),
        F.when(F.col("doc_id") % 7 == 0, -1.0).otherwise(F.col("n_chars") / 1000.0).alias("confidence"))
    return readers.normalize_classifications(raw)


@query("read_classifications", f"SELECT market_id, category, round(confidence,4) AS confidence, status, insider_plausible FROM ({CLS_SQL})")
def _(spark, sf):
    return classifications(spark, sf).select("market_id", "category", *rnd("confidence", digits=4), "status", "insider_plausible")


@query("align_classifications", f"SELECT l.doc_id AS market_id, category, coalesce(status, 'missing') AS status FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT * FROM ({CLS_SQL}) WHERE market_id % 5<>0) c ON c.market_id=l.doc_id")
def _(spark, sf):
    ids = tables.read(spark, sf, "labels").select(F.col("doc_id").alias("market_id")).distinct()
    res = classifications(spark, sf).where("market_id % 5 <> 0")
    return readers.align_classifications(ids, res.unionByName(res), ["category"]).select("market_id", "category", "status")


@query("classification_summary", f"""SELECT CASE WHEN status='failed' THEN 'FAILED' ELSE category END AS category, count(*) AS n, count_if(insider_plausible) AS plausible FROM ({CLS_SQL}) GROUP BY 1
 UNION ALL SELECT 'ALL', count(*), count_if(insider_plausible) FROM ({CLS_SQL})""")
def _(spark, sf):
    named = classifications(spark, sf).withColumn("category", F.when(F.col("status") == "failed", "FAILED").otherwise(F.col("category")))
    return named.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("insider_plausible").alias("plausible")).withColumn(
        "category", F.coalesce("category", F.lit("ALL")))


@query("read_reported_cases", """SELECT c_nationkey AS case_id, wallet, count(*) AS times, regexp_matches(wallet,'^0x[0-9a-f]{40}$') AS valid FROM (
 SELECT c_nationkey, unnest(['0x'||lpad(CAST(c_custkey % 97 AS VARCHAR),40,'0'), '0x'||lpad(CAST(c_custkey % 89 AS VARCHAR),CASE WHEN c_custkey % 10=0 THEN 39 ELSE 40 END,'0')]) AS wallet FROM customer) GROUP BY 1,2""")
def _(spark, sf):
    c = tables.read(spark, sf, "customer")
    a = F.concat(F.lit(" 0X"), F.lpad((F.col("c_custkey") % 97).cast("string"), 40, "0"))
    k = (F.col("c_custkey") % 89).cast("string")
    b = F.concat(F.lit("0x"), F.when(F.col("c_custkey") % 10 == 0, F.lpad(k, 39, "0")).otherwise(F.lpad(k, 40, "0")))
    return readers.read_reported_cases(c.select(F.col("c_nationkey").alias("case_id"), F.array(a, b).alias("reported_wallets")))


@query("market_prompt_text", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(lang) WHEN 1 THEN trim(source) ELSE trim(text,' ') END AS prompt FROM documents")
def _(spark, sf):
    d = tables.read(spark, sf, "documents")
    k = F.col("doc_id") % 3
    raw = d.select("doc_id", F.when(k == 0, F.col("lang")).when(k == 1, "nan").alias("question"), F.when(k == 1, F.col("source")).otherwise(" ").alias("title"), F.col("text").alias("description"))
    return readers.market_prompt_text(raw).select("doc_id", "prompt")


# ---- sinks ------------------------------------------------------------------
SIGNALS_SQL = "concat_ws(' | '," + ",".join(
    f"CASE WHEN conf_{d}>0 THEN '{d}('||printf('%.2f',round(conf_{d},2))||')' END" for d in
    ("volume_anomaly", "probability_impact", "accumulation", "extreme_position", "contra_silence")) + ")"


@query("alert_sink", f"SELECT tx_hash, market_id, wallet, {r('total_score')}, regexp_replace(sig,'[0-9.]+\\)',')','g') AS signals FROM (SELECT *, {SIGNALS_SQL} AS sig FROM scored WHERE is_alert)")
def _(spark, sf):
    df = sinks.alert_rows(scoring.alerts(frozen(spark, sf)))
    return df.select("tx_hash", "market_id", "wallet", *rnd("total_score"), F.regexp_replace("signals", r"[0-9.]+\)", ")").alias("signals"))


STATS_SQL = """SELECT wallet, market_id, count(*) AS trade_count, sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END) AS total_buy_notional,
 sum(CASE WHEN side='BUY' THEN 0 ELSE notional_usdc END) AS total_sell_notional, min(timestamp_ms) AS first_trade_ts, max(timestamp_ms) AS last_trade_ts,
 count_if(is_alert) AS flag_count, max(timestamp_ms) FILTER (is_alert) AS last_flag_ts FROM scored GROUP BY 1,2"""


@query("wallet_market_stats", f"SELECT wallet, market_id, trade_count, {r('total_buy_notional total_sell_notional', 3)}, first_trade_ts, last_trade_ts, flag_count, last_flag_ts FROM ({STATS_SQL})")
def _(spark, sf):
    s = frozen(spark, sf)
    return rounded(sinks.wallet_market_stats(s, s.where("is_alert")), 3)


@query("wallet_outcome_positions", """SELECT wallet, market_id, outcome_index, round(sum(CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END)+0.0,3) AS net_shares,
 round(sum(CASE WHEN side='BUY' THEN size_tokens ELSE 0 END),3) AS buy_shares, round(sum(CASE WHEN side='BUY' THEN 0 ELSE size_tokens END),3) AS sell_shares,
 round(sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END),3) AS buy_notional, round(sum(CASE WHEN side='BUY' THEN 0 ELSE notional_usdc END),3) AS sell_notional FROM tape GROUP BY 1,2,3""")
def _(spark, sf):
    return rounded(sinks.wallet_outcome_positions(tape(spark, sf)), 3)


@query("participation_log", "SELECT market_id, wallet, timestamp_ms//1000 AS timestamp_s, side, outcome_index, round(arg_min(notional_usdc, seq),4) AS size FROM tape GROUP BY 1,2,3,4,5")
def _(spark, sf):
    t = tape(spark, sf)
    return rounded(sinks.participation_log(t.unionByName(t)).drop("seq"), 4)


@query("resolution_cache_upsert", "SELECT market_id, winner, CAST(2 AS INTEGER) AS version FROM winners UNION ALL SELECT market_id, NULL, 1 FROM markets WHERE market_id NOT IN (SELECT market_id FROM winners)")
def _(spark, sf):
    old = tables.markets(spark, sf).select("market_id", F.lit(None).cast("int").alias("winner"), F.lit(1).alias("version"))
    new = winners(spark, sf).select("market_id", "winner", F.lit(2).alias("version"))
    return sinks.latest_per_key(old.unionByName(new), ["market_id"], ["version"])


@query("resolution_job_summary", """SELECT count(*) AS markets, count(w.winner) AS resolved, count(*)-count(w.winner)-count_if(m.volume IS NULL) AS unresolved, count_if(m.volume IS NULL) AS no_trades,
 min(close_ms) AS min_close_ms, max(close_ms) AS max_close_ms FROM markets m LEFT JOIN winners w USING (market_id)""")
def _(spark, sf):
    return sinks.resolution_job_summary(labels.resolution_table(tape(spark, sf), tables.markets(spark, sf), RESOLUTION_THRESHOLD))


@query("export_results", "SELECT market_id, count(*) AS n, round(sum(notional_usdc),2) AS notional FROM tape GROUP BY 1")
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    df = tape(spark, sf).groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("notional_usdc"), 2).alias("notional"))
    sinks.export_results(df, path)
    return spark.read.schema(df.schema).json(path)


@query("resolution_payload", """SELECT market_id, '{"slug":"'||market_slug||'"'||CASE WHEN winner IS NULL THEN '' ELSE ',"winning_outcome":'||winner END||',"resolution_date":"'||CAST(make_timestamp(close_ms*1000) AS DATE)||'","note":"inferred"}' AS payload FROM markets LEFT JOIN winners USING (market_id)""")
def _(spark, sf):
    m = tables.markets(spark, sf).join(winners(spark, sf), "market_id", "left")
    return sinks.resolution_payload(m.withColumns({"resolution_date": F.date_format(F.timestamp_millis("close_ms"), "yyyy-MM-dd"), "note": F.lit("inferred")}))
