"""Shared inputs of the queries, and the same inputs as SQL views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.config import make_config
from tapescope.operators import economics, evaluation, labels, scoring
from tapescope.plans.registry import VIEWS, view
from tapescope.session import kept
from tapescope.sources import tables

# Settings of the registered queries, tuned to the value ranges of the tables.
CFG = make_config(
    probability_impact={"min_delta_prob": 0.30, "min_delta_log_odds": 1.5},
    contra_silence={"max_contra_age_minutes": 1440.0},
    volume_anomaly={"min_trades_for_baseline": 5},
    clustering={"bucket_size": 21_600, "size_normalizer": 5000.0, "min_edge_weight": 1.0},
    jumps={"jump_window_minutes": 720, "pre_jump_lookback_minutes": 1440},
    labels={"z_score_threshold": 1.0},
)
RESOLUTION_THRESHOLD = 0.5


def rnd(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]


def tape(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return tables.tape(spark, sf)


def winners(spark: SparkSession, sf: str) -> DataFrame:
    return labels.winners(tape(spark, sf), RESOLUTION_THRESHOLD)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.replay(tape(spark, sf), CFG)


view("tape", """
SELECT event_id AS seq, epoch_us(ts)//1000 AS timestamp_ms,
  '0x'||lpad(CAST(user_id AS VARCHAR),40,'0') AS wallet,
  CAST(event_id % 25 AS INTEGER) AS market_id,
  CAST(CAST(json_extract_string(props,'$.k') AS INTEGER) % 2 AS INTEGER) AS outcome_index,
  CASE WHEN event_type IN ('purchase','signup','view') THEN 'BUY' ELSE 'SELL' END AS side,
  (CAST(json_extract_string(props,'$.k') AS INTEGER)+1)/CAST(101.0 AS DOUBLE) AS price,
  value*100.0 AS notional_usdc,
  value*100.0/((CAST(json_extract_string(props,'$.k') AS INTEGER)+1)/CAST(101.0 AS DOUBLE)) AS size_tokens,
  'tx'||CAST(event_id AS VARCHAR) AS tx_hash
FROM events""")

view("n_users", "SELECT count(DISTINCT user_id) AS n FROM events")

view("markets", """
SELECT n_nationkey AS market_id, n_name AS market_slug, r_name AS category, volume, close_ms
FROM nation JOIN region ON n_regionkey=r_regionkey
LEFT JOIN (SELECT market_id, sum(notional_usdc) AS volume, max(timestamp_ms) AS close_ms FROM tape GROUP BY 1) v
  ON v.market_id=n_nationkey""")

view("transfers", """
SELECT 't'||CAST(o_orderkey AS VARCHAR) AS tx_hash, epoch_us(o_orderdate)//1000000 AS timestamp_s,
  '0x'||lpad(CAST(o_custkey % n AS VARCHAR),40,'0') AS from_address,
  '0x'||lpad(CAST((o_custkey*7+o_orderkey) % n AS VARCHAR),40,'0') AS to_address,
  o_totalprice AS value_usdc
FROM orders, n_users""")

view("fills", """
SELECT seq, strftime(make_timestamp(timestamp_ms*1000),'%Y-%m-%dT%H:%M:%S.%g') AS "timestamp", market_id, wallet AS maker,
  '0x'||lpad(CAST((CAST(substr(wallet,3) AS BIGINT)+1) % n AS VARCHAR),40,'0') AS taker,
  CASE WHEN outcome_index=0 THEN 'token1' ELSE 'token2' END AS nonusdc_side,
  side AS maker_direction, CASE WHEN side='BUY' THEN 'SELL' ELSE 'BUY' END AS taker_direction,
  price, notional_usdc AS usd_amount, size_tokens AS token_amount, tx_hash AS transactionHash
FROM tape, n_users""")

view("book_levels", """
SELECT CAST(l_partkey % 50 AS INTEGER) AS asset_id, CAST(19722+date_diff('day',DATE '1992-01-01',CAST(l_shipdate AS DATE)) % 30 AS BIGINT)*86400000 AS book_ms,
  l_linenumber % 2=1 AS is_bid, round(CASE WHEN l_linenumber % 2=1 THEN 0.50-l_discount ELSE 0.51+l_tax END,4) AS price,
  sum(l_quantity) AS size
FROM lineitem GROUP BY 1,2,3,4""")

view("winners", f"""
SELECT market_id, CAST(max_by(outcome_index, last_price) AS INTEGER) AS winner FROM (
  SELECT market_id, outcome_index, arg_max(price, (timestamp_ms, seq)) AS last_price FROM tape GROUP BY 1,2)
WHERE last_price >= {RESOLUTION_THRESHOLD} GROUP BY 1""")

# ---- running state, written with plain (unchunked) windows -----------------
view("wstate", """
SELECT *,
  count(*) OVER w AS w_trades, coalesce(sum(notional_usdc) OVER w,0) AS w_volume,
  min(timestamp_ms) OVER w AS w_first_ts,
  coalesce(sum(CASE WHEN outcome_index=0 THEN (CASE WHEN side='BUY' THEN 1 ELSE -1 END)*size_tokens END) OVER w,0) AS w_shares0,
  coalesce(sum(CASE WHEN outcome_index=1 THEN (CASE WHEN side='BUY' THEN 1 ELSE -1 END)*size_tokens END) OVER w,0) AS w_shares1,
  coalesce(sum(CASE WHEN outcome_index=0 THEN notional_usdc END) OVER w,0) AS w_vol0,
  coalesce(sum(CASE WHEN outcome_index=1 THEN notional_usdc END) OVER w,0) AS w_vol1,
  last_value(CASE WHEN outcome_index=0 THEN price END IGNORE NULLS) OVER w AS w_price0,
  last_value(CASE WHEN outcome_index=1 THEN price END IGNORE NULLS) OVER w AS w_price1
FROM tape WINDOW w AS (PARTITION BY market_id, wallet ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

view("wratio", """
SELECT *,
  abs(w_shares0*coalesce(w_price0,0))+abs(w_shares1*coalesce(w_price1,0)) AS net_exposure,
  CASE WHEN w_volume>0 THEN least(1.0,(abs(w_shares0*coalesce(w_price0,0))+abs(w_shares1*coalesce(w_price1,0)))/w_volume) ELSE 0 END AS directional_ratio,
  abs((CASE WHEN outcome_index=0 THEN w_shares0 ELSE w_shares1 END)*coalesce(CASE WHEN outcome_index=0 THEN w_price0 ELSE w_price1 END,price)) AS outcome_exposure,
  CASE WHEN (CASE WHEN outcome_index=0 THEN w_vol0 ELSE w_vol1 END)>=1e-6 THEN
   least(1.0,abs((CASE WHEN outcome_index=0 THEN w_shares0 ELSE w_shares1 END)*coalesce(CASE WHEN outcome_index=0 THEN w_price0 ELSE w_price1 END,0))
     /(CASE WHEN outcome_index=0 THEN w_vol0 ELSE w_vol1 END)) ELSE 0 END AS outcome_directional,
  CASE WHEN w_volume>=1e-6 THEN least(1.0,(CASE WHEN outcome_index=0 THEN w_vol0 ELSE w_vol1 END)/w_volume) ELSE 0 END AS outcome_concentration,
  (w_vol0>0 AND w_vol1>0 AND least(w_vol0,w_vol1)/(w_vol0+w_vol1)>=0.3) AS is_hedged
FROM wstate""")

view("base_incl", """
SELECT seq, market_id, timestamp_ms,
  count(*) OVER r - coalesce(count(*) OVER o,0) AS n,
  sum(notional_usdc) OVER r - coalesce(sum(notional_usdc) OVER o,0) AS s,
  sum(notional_usdc*notional_usdc) OVER r - coalesce(sum(notional_usdc*notional_usdc) OVER o,0) AS q
FROM tape WINDOW
  r AS (PARTITION BY market_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  o AS (PARTITION BY market_id ORDER BY timestamp_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 86400001 PRECEDING)""")

view("baseline", """
SELECT seq, coalesce(bn,0) AS base_n, bs/bn AS base_mean,
  CASE WHEN bn>=2 THEN sqrt(greatest((bq-bs*bs/bn)/(bn-1),0)) END AS base_std
FROM (SELECT seq, lag(n) OVER w AS bn, lag(s) OVER w AS bs, lag(q) OVER w AS bq FROM base_incl
  WINDOW w AS (PARTITION BY market_id ORDER BY timestamp_ms, seq))""")

view("mstate", """
SELECT seq, market_id, outcome_index, timestamp_ms,
  count(*) OVER w AS market_trades_before,
  CASE outcome_index WHEN 0 THEN last_value(CASE WHEN outcome_index=0 THEN price END IGNORE NULLS) OVER w
    ELSE last_value(CASE WHEN outcome_index=1 THEN price END IGNORE NULLS) OVER w END AS prev_price,
  CASE outcome_index WHEN 0 THEN last_value(CASE WHEN outcome_index=0 THEN timestamp_ms END IGNORE NULLS) OVER w
    ELSE last_value(CASE WHEN outcome_index=1 THEN timestamp_ms END IGNORE NULLS) OVER w END AS own_prev_ts,
  CASE outcome_index WHEN 1 THEN last_value(CASE WHEN outcome_index=0 THEN timestamp_ms END IGNORE NULLS) OVER w
    ELSE last_value(CASE WHEN outcome_index=1 THEN timestamp_ms END IGNORE NULLS) OVER w END AS contra_ts
FROM tape WINDOW w AS (PARTITION BY market_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

view("gapmed", """
SELECT market_id, outcome_index, timestamp_ms, seq, timestamp_ms-own_prev_ts AS gap_ms,
  median(timestamp_ms-own_prev_ts) OVER w AS gap_median, count(*) OVER w AS gap_n
FROM mstate WHERE timestamp_ms-own_prev_ts>0
WINDOW w AS (PARTITION BY market_id, outcome_index ORDER BY timestamp_ms, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")

view("contragap", """
SELECT t.seq, arg_max(g.gap_median,(g.timestamp_ms,g.seq)) AS contra_gap_median, arg_max(g.gap_n,(g.timestamp_ms,g.seq)) AS contra_gap_n
FROM mstate t JOIN gapmed g ON g.market_id=t.market_id AND g.outcome_index=1-t.outcome_index
 AND (g.timestamp_ms<t.timestamp_ms OR (g.timestamp_ms=t.timestamp_ms AND g.seq<t.seq))
GROUP BY 1""")

_v, _p, _a, _e, _c = (CFG[k] for k in ("volume_anomaly", "probability_impact", "accumulation", "extreme_position",
                                       "contra_silence"))
view("detected", f"""
SELECT t.*, b.base_n, b.base_mean, b.base_std, m.prev_price, m.contra_ts, g.contra_gap_median, coalesce(g.contra_gap_n,0) AS contra_gap_n,
 CASE WHEN t.notional_usdc>={_v['min_absolute_notional']} AND NOT (w_volume>=10000 AND directional_ratio<0.5)
   AND base_n>={_v['min_trades_for_baseline']} AND base_std>=1e-6 AND (t.notional_usdc-base_mean)/base_std>={_v['z_score_threshold']}
   THEN {_v['max_confidence']}/(1+exp(-((t.notional_usdc-base_mean)/base_std-{_v['z_score_threshold']})/1.5)) ELSE 0 END AS conf_volume_anomaly,
 CASE WHEN t.notional_usdc>={_p['min_notional']} AND abs(t.price-prev_price)>=1e-6 THEN
   coalesce(CASE WHEN abs(t.price-prev_price)>={_p['min_delta_prob']} AND abs(ln(t.price/(1-t.price))-ln(prev_price/(1-prev_price)))>={_p['min_delta_log_odds']}
     THEN 0.4*least(1.0,abs(t.price-prev_price)/(2*{_p['min_delta_prob']}))+0.6*least(1.0,abs(ln(t.price/(1-t.price))-ln(prev_price/(1-prev_price)))/(2*{_p['min_delta_log_odds']}))
     WHEN abs(t.price-prev_price)>={_p['min_delta_prob']} THEN least(1.0,abs(t.price-prev_price)/(2*{_p['min_delta_prob']}))
     WHEN abs(ln(t.price/(1-t.price))-ln(prev_price/(1-prev_price)))>={_p['min_delta_log_odds']}
       THEN least(1.0,abs(ln(t.price/(1-t.price))-ln(prev_price/(1-prev_price)))/(2*{_p['min_delta_log_odds']})) END,0)*{_p['max_confidence']} ELSE 0 END AS conf_probability_impact,
 CASE WHEN t.side='BUY' AND w_trades>0 AND outcome_concentration>={_a['min_outcome_concentration']} AND outcome_directional>={_a['min_directional_ratio']}
   AND outcome_exposure>={_a['min_accumulation_usdc']} THEN outcome_directional*{_a['max_confidence']} ELSE 0 END AS conf_accumulation,
 CASE WHEN t.notional_usdc>={_e['min_notional']} AND NOT (w_volume>=10000 AND directional_ratio<0.5)
   AND ((t.price<{_e['tail_threshold']} AND t.side='BUY') OR (t.price>1-{_e['tail_threshold']} AND t.side='SELL'))
   THEN (0.5*least(1.0,(CASE WHEN t.price<{_e['tail_threshold']} THEN {_e['tail_threshold']}-t.price ELSE t.price-(1-{_e['tail_threshold']}) END)/{_e['tail_threshold']})
     +0.5*least(1.0,t.notional_usdc/5000))*{_e['max_confidence']} ELSE 0 END AS conf_extreme_position,
 CASE WHEN t.notional_usdc>={_c['min_notional']} AND t.timestamp_ms-contra_ts>0 AND t.timestamp_ms-contra_ts<={_c['max_contra_age_minutes']}*60000
   AND contra_gap_n>={_c['min_gap_samples']} AND contra_gap_median>0 AND (t.timestamp_ms-contra_ts)/contra_gap_median>={_c['silence_threshold']}
   THEN least(1.0,(t.timestamp_ms-contra_ts)/contra_gap_median/(2*{_c['silence_threshold']}))*{_c['max_confidence']} ELSE 0 END AS conf_contra_silence
FROM wratio t JOIN baseline b USING (seq) JOIN mstate m USING (seq) LEFT JOIN contragap g USING (seq)""")

view("scored", f"""
SELECT *, base_score AS total_score, base_score>={CFG['alert_threshold']} AS is_alert FROM (
 SELECT *, 1-(1-conf_volume_anomaly)*(1-conf_probability_impact)*(1-conf_accumulation)*(1-conf_extreme_position)*(1-conf_contra_silence) AS base_score
 FROM detected)""")


REPLAYED = ("wstate", "wratio", "base_incl", "baseline", "mstate", "gapmed", "contragap", "detected", "scored")


def replay_views(suffix: str, tape_sql: str) -> None:
    """The tape and all views up to ``scored`` again, named with a suffix, over another tape."""
    view(f"tape{suffix}", tape_sql)
    for name in REPLAYED:
        view(f"{name}{suffix}", re.sub(rf"\b({'|'.join(('tape', *REPLAYED))})\b", rf"\g<1>{suffix}", VIEWS[name]))


# ---- labels, flags and evaluations -----------------------------------------
FLAG_RATE = 0.5
FROZEN = ["seq", "market_id", "wallet", "timestamp_ms", "side", "outcome_index", "price", "notional_usdc",
          "size_tokens", "tx_hash", "base_score", "total_score", "is_alert"]


def frozen(spark: SparkSession, sf: str, cfg: dict = CFG) -> DataFrame:
    """The replay written once and read by everything downstream (frozen signals)."""
    def replayed() -> DataFrame:
        df = scoring.replay(tape(spark, sf), cfg)
        return df.select(*FROZEN, *scoring.conf_columns(df))

    return kept(spark, f"frozen {sf} {cfg}", replayed)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return labels.ground_truth(tape(spark, sf), winners(spark, sf), CFG)


def evaluations(spark: SparkSession, sf: str, signals: DataFrame | None = None) -> DataFrame:
    signals = frozen(spark, sf) if signals is None else signals
    return evaluation.wallet_evaluations(truth(spark, sf), scoring.wallet_suspicion(signals))


def predicted(spark: SparkSession, sf: str, signals: DataFrame | None = None) -> DataFrame:
    return evaluations(spark, sf, signals).withColumn(
        "predicted", evaluation.predict("flag_rate", flag_rate_threshold=FLAG_RATE))


def flagged_buys(spark: SparkSession, sf: str, signals: DataFrame | None = None) -> DataFrame:
    signals = frozen(spark, sf) if signals is None else signals
    return economics.flagged_buys(tape(spark, sf), winners(spark, sf), economics.flag_keys(signals))


view("positions", """
SELECT market_id, wallet, sum(CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) AS net_shares,
 sum(CASE WHEN side='BUY' THEN notional_usdc ELSE -notional_usdc END) AS net_cost, sum(notional_usdc) AS notional,
 sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END) AS gross_buy, count(*) AS trade_count
FROM tape GROUP BY 1,2""")

_l = CFG["labels"]
view("pnl", f"""
SELECT *, CASE WHEN gross_buy>1e-9 THEN net_pnl/gross_buy ELSE 0 END AS wallet_return,
 CASE WHEN gross_buy>1e-9 THEN net_pnl/gross_buy*log2(1+gross_buy/1000) ELSE 0 END AS informed_score FROM (
 SELECT market_id, winner, wallet,
  sum(CASE WHEN outcome_index=winner THEN (CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) ELSE 0 END) AS payout,
  sum(CASE WHEN side='BUY' THEN notional_usdc ELSE -notional_usdc END) AS net_cost,
  sum(CASE WHEN outcome_index=winner THEN (CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) ELSE 0 END)
   - sum(CASE WHEN side='BUY' THEN notional_usdc ELSE -notional_usdc END) AS net_pnl,
  sum(notional_usdc) AS total_notional, sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END) AS gross_buy, count(*) AS trade_count
 FROM tape JOIN winners USING (market_id) GROUP BY 1,2,3 HAVING sum(notional_usdc)>={_l['min_wallet_notional']})""")

view("truth", f"""
SELECT *, z_score>{_l['z_score_threshold']} AS is_insider FROM (
 SELECT *, CASE WHEN label_std>1e-12 THEN (wallet_return-label_mean)/label_std ELSE 0 END AS z_score FROM (
  SELECT *, avg(wallet_return) OVER m AS label_mean, stddev_samp(wallet_return) OVER m AS label_std, count(*) OVER m AS nw
  FROM pnl WINDOW m AS (PARTITION BY market_id)) WHERE nw>={_l['min_wallets']})""")

view("suspicion", """
SELECT market_id, wallet, sum(total_score) AS suspicion, count_if(is_alert) AS num_flags, count(*) AS trade_count,
 sum(notional_usdc) AS notional, sum(CASE WHEN side='BUY' THEN notional_usdc ELSE 0 END) AS gross_buy,
 sum(CASE WHEN outcome_index=0 THEN (CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) ELSE 0 END) AS shares0,
 sum(CASE WHEN outcome_index=0 THEN (CASE WHEN side='BUY' THEN notional_usdc ELSE -notional_usdc END) ELSE 0 END) AS cost0,
 sum(CASE WHEN outcome_index=1 THEN (CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) ELSE 0 END) AS shares1,
 sum(CASE WHEN outcome_index=1 THEN (CASE WHEN side='BUY' THEN notional_usdc ELSE -notional_usdc END) ELSE 0 END) AS cost1
FROM scored GROUP BY 1,2""")

view("evals", f"""
SELECT t.*, coalesce(s.suspicion,0) AS suspicion, CAST(coalesce(s.num_flags,0) AS BIGINT) AS num_flags,
 coalesce(s.num_flags,0)>0 AS has_alert, coalesce(s.num_flags,0)/t.trade_count AS flag_rate,
 coalesce(s.num_flags,0)/t.trade_count>={FLAG_RATE} AS predicted
FROM truth t LEFT JOIN suspicion s USING (market_id, wallet)""")

view("buys", """
SELECT t.*, winner, outcome_index=winner AS is_win,
 CASE WHEN outcome_index=winner THEN (1-price)/price ELSE -1 END AS trade_return,
 CASE WHEN outcome_index=winner THEN size_tokens ELSE 0 END AS payout,
 CASE WHEN outcome_index=winner THEN size_tokens ELSE 0 END - notional_usdc AS pnl,
 CASE WHEN notional_usdc>1e-9 THEN (CASE WHEN outcome_index=winner THEN size_tokens ELSE 0 END - notional_usdc)/notional_usdc ELSE 0 END AS pnl_return
FROM tape t JOIN winners USING (market_id) WHERE side='BUY'""")

view("flags", """
SELECT market_id, wallet, timestamp_ms, arg_max(total_score, seq) AS flag_score,
 arg_max(list_filter([CASE WHEN conf_volume_anomaly>0 THEN 'volume_anomaly' END, CASE WHEN conf_probability_impact>0 THEN 'probability_impact' END,
  CASE WHEN conf_accumulation>0 THEN 'accumulation' END, CASE WHEN conf_extreme_position>0 THEN 'extreme_position' END,
  CASE WHEN conf_contra_silence>0 THEN 'contra_silence' END], lambda x: x IS NOT NULL), seq) AS flag_detectors
FROM scored WHERE is_alert GROUP BY 1,2,3""")

view("fbuys", """
SELECT b.*, f.flag_score, f.flag_detectors, f.flag_score IS NOT NULL AS is_flagged
FROM buys b LEFT JOIN flags f USING (market_id, wallet, timestamp_ms)""")

view("study", """
SELECT market_id, winner, count(*) AS total_buy_trades, count_if(is_flagged) AS flagged_buy_trades, count_if(NOT is_flagged) AS unflagged_buy_trades,
 sum(notional_usdc) FILTER (is_flagged) AS flagged_total_notional, sum(notional_usdc) FILTER (NOT is_flagged) AS unflagged_total_notional,
 avg(trade_return) FILTER (is_flagged) AS flagged_mean_return, avg(trade_return) FILTER (NOT is_flagged) AS unflagged_mean_return,
 median(trade_return) FILTER (is_flagged) AS flagged_median_return, median(trade_return) FILTER (NOT is_flagged) AS unflagged_median_return,
 coalesce(stddev_samp(trade_return) FILTER (is_flagged),0) AS flagged_std_return, coalesce(stddev_samp(trade_return) FILTER (NOT is_flagged),0) AS unflagged_std_return,
 var_samp(trade_return) FILTER (is_flagged) AS fv, var_samp(trade_return) FILTER (NOT is_flagged) AS uv,
 sum(trade_return*notional_usdc) FILTER (is_flagged)/sum(notional_usdc) FILTER (is_flagged) AS flagged_weighted_return,
 sum(trade_return*notional_usdc) FILTER (NOT is_flagged)/sum(notional_usdc) FILTER (NOT is_flagged) AS unflagged_weighted_return,
 count_if(is_flagged AND is_win)/count_if(is_flagged) AS flagged_win_rate, count_if(NOT is_flagged AND is_win)/count_if(NOT is_flagged) AS unflagged_win_rate
FROM fbuys GROUP BY 1,2 HAVING count_if(is_flagged)>=1 AND count_if(NOT is_flagged)>=1""")

view("study_d", """
SELECT *, flagged_mean_return-unflagged_mean_return AS mean_return_diff,
 coalesce(CASE WHEN flagged_buy_trades>=2 AND unflagged_buy_trades>=2 AND sqrt(((flagged_buy_trades-1)*fv+(unflagged_buy_trades-1)*uv)/(total_buy_trades-2))>=1e-12
   THEN (flagged_mean_return-unflagged_mean_return)/sqrt(((flagged_buy_trades-1)*fv+(unflagged_buy_trades-1)*uv)/(total_buy_trades-2)) END,0) AS cohens_d,
 coalesce(CASE WHEN flagged_buy_trades>=2 AND unflagged_buy_trades>=2 AND fv/flagged_buy_trades+uv/unflagged_buy_trades>0
   THEN (flagged_mean_return-unflagged_mean_return)/sqrt(fv/flagged_buy_trades+uv/unflagged_buy_trades) END,0) AS welch_t,
 CASE WHEN flagged_buy_trades>=2 AND unflagged_buy_trades>=2 AND fv/flagged_buy_trades+uv/unflagged_buy_trades>0
   THEN (fv/flagged_buy_trades+uv/unflagged_buy_trades)**2/((fv/flagged_buy_trades)**2/(flagged_buy_trades-1)+(uv/unflagged_buy_trades)**2/(unflagged_buy_trades-1)) END AS welch_df
FROM study""")

BANDS_SQL = " ".join(f"WHEN flag_score<{hi} THEN '{name}'" for hi, name in
                     [(0.6, "0.5-0.6"), (0.7, "0.6-0.7"), (0.8, "0.7-0.8"), (0.9, "0.8-0.9"), (1.01, "0.9-1.0")])
