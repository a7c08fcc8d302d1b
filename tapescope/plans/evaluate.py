"""Queries over labels, evaluations and the economics of flagged trades."""

from pyspark.sql import functions as F

from tapescope.operators import economics, evaluation, labels, scoring
from tapescope.plans.base import (
    BANDS_SQL, CFG, FLAG_RATE, RESOLUTION_THRESHOLD, evaluations, flagged_buys, frozen, predicted, rnd, tape, truth, winners)
from tapescope.plans.registry import query
from tapescope.sources import tables


def rounded(df, digits=6, skip=()):
    """Round every floating column, so that sums in another order compare equal."""
    return df.select(*[
        F.round(F.col(c) + 0.0, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c)
        for c, t in df.dtypes])


def r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}+0.0,{digits}) AS {c}" for c in cols.split())


# ---- scores and alerts ------------------------------------------------------
@query("noisy_or", f"SELECT seq, {r('base_score')} FROM scored")
def _(spark, sf):
    return frozen(spark, sf).select("seq", *rnd("base_score"))


@query("boosted_score", f"""
SELECT seq, round(least(base_score*CAST(CAST(1+(seq % 5)*0.13 AS FLOAT) AS DOUBLE),{CFG['score_cap']}),6) AS total_score FROM scored""")
def _(spark, sf):
    m = F.lit(1.0) + F.pmod("seq", F.lit(5)) * 0.13
    return frozen(spark, sf).select("seq", F.round(
        scoring.boosted(F.col("base_score"), m, CFG["score_cap"]), 6).alias("total_score"))


@query("alerts", f"SELECT seq, market_id, wallet, {r('total_score')}, len(flag_list) AS n_signals FROM (SELECT *, {'list_filter([conf_volume_anomaly,conf_probability_impact,conf_accumulation,conf_extreme_position,conf_contra_silence], lambda x: x>0)'} AS flag_list FROM scored WHERE is_alert)")
def _(spark, sf):
    return scoring.alerts(frozen(spark, sf)).select(
        "seq", "market_id", "wallet", *rnd("total_score"), F.size("signals").cast("long").alias("n_signals"))


@query("trade_features", f"""
SELECT market_id, seq, wallet, timestamp_ms, round(notional_usdc,4) AS notional_usdc, round(price,6) AS price, side, outcome_index, {r('total_score')},
 CAST((conf_volume_anomaly>0)::INT+(conf_probability_impact>0)::INT+(conf_accumulation>0)::INT+(conf_extreme_position>0)::INT+(conf_contra_silence>0)::INT AS INTEGER) AS num_detectors_fired,
 CAST(is_alert AS INTEGER) AS is_alert, {r('conf_volume_anomaly conf_probability_impact conf_accumulation conf_extreme_position conf_contra_silence')} FROM scored""")
def _(spark, sf):
    df = scoring.trade_features(scoring.replay(tape(spark, sf), CFG))
    return rounded(df.withColumn("notional_usdc", F.round("notional_usdc", 4)))


@query("detector_stats", " UNION ALL ".join(
    f"SELECT '{d}' AS detector, count_if(conf_{d}>0) AS fires FROM scored" for d in
    ("volume_anomaly", "probability_impact", "accumulation", "extreme_position", "contra_silence")))
def _(spark, sf):
    return scoring.detector_stats(scoring.replay(tape(spark, sf), CFG))


@query("wallet_suspicion", f"""
SELECT market_id, wallet, {r('suspicion')}, num_flags, trade_count, {r('notional gross_buy shares0 cost0 shares1 cost1', 3)} FROM suspicion""")
def _(spark, sf):
    df = scoring.wallet_suspicion(scoring.replay(tape(spark, sf), CFG))
    return df.select("market_id", "wallet", *rnd("suspicion"), "num_flags", "trade_count",
                     *[F.round(F.col(c) + 0.0, 3).alias(c) for c in ("notional", "gross_buy", "shares0", "cost0", "shares1", "cost1")])


@query("frozen_signals", f"SELECT seq, {r('base_score total_score conf_accumulation conf_contra_silence')}, is_alert FROM scored")
def _(spark, sf):
    return frozen(spark, sf).select("seq", *rnd("base_score", "total_score", "conf_accumulation", "conf_contra_silence"), "is_alert")


@query("threshold_rescore", """
SELECT threshold, count(*) AS trades, count_if(total_score>=threshold) AS alerts, round(count_if(total_score>=threshold)/count(*),6) AS alert_rate
FROM scored, (SELECT CAST(i AS DOUBLE)/20 AS threshold FROM range(1,20) t(i)) GROUP BY 1""")
def _(spark, sf):
    thr = spark.range(1, 20).select((F.col("id") / 20.0).alias("threshold"))
    return scoring.rescore(frozen(spark, sf), thr).select("threshold", "trades", "alerts", *rnd("alert_rate"))


@query("detector_rescore", """
SELECT seq, round(1-(1-conf_volume_anomaly)*(1-conf_probability_impact)*(1-conf_accumulation)*(1-c)*(1-conf_contra_silence),6) AS total_score FROM (
 SELECT *, CASE WHEN notional_usdc>=2000 AND NOT (w_volume>=10000 AND directional_ratio<0.5)
   AND ((price<0.3 AND side='BUY') OR (price>1-0.3 AND side='SELL'))
   THEN (0.5*least(1.0,(CASE WHEN price<0.3 THEN 0.3-price ELSE price-(1-0.3) END)/0.3)+0.5*least(1.0,notional_usdc/5000))*0.4 ELSE 0 END AS c FROM scored)""")
def _(spark, sf):
    from tapescope.config import make_config
    cfg = make_config(**{**CFG, "extreme_position": {"tail_threshold": 0.3, "min_notional": 2000.0, "max_confidence": 0.4}})
    full = scoring.replay(tape(spark, sf), CFG)
    return scoring.replace_detector(full, cfg, "extreme_position").select("seq", *rnd("total_score"))


@query("recidivism", """
SELECT seq, prior_flags, round(CASE WHEN prior_flags>=1 THEN round(0.8/(1+exp(-0.7*(prior_flags-5))),4) ELSE 0 END,4) AS confidence FROM (
 SELECT seq, CAST(coalesce(sum(is_alert::INT) OVER (PARTITION BY market_id, wallet ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS prior_flags FROM scored)""")
def _(spark, sf):
    from tapescope.operators import detectors
    df = scoring.prior_flags(frozen(spark, sf))
    return df.select("seq", "prior_flags", detectors.recidivism(CFG, F.col("prior_flags")).alias("confidence"))


@query("recidivism_replay", """
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY market_id, wallet ORDER BY timestamp_ms, seq) AS rn FROM scored),
step AS (
 SELECT market_id, wallet, rn, seq, 0 AS before, base_score AS s, CAST(base_score>=0.5 AS INTEGER) AS hit FROM ranked WHERE rn=1
 UNION ALL
 SELECT market_id, wallet, rn, seq, before, s, CAST(s>=0.5 AS INTEGER) FROM (
  SELECT r.market_id, r.wallet, r.rn, r.seq, p.before+p.hit AS before,
   1-(1-r.base_score)*(1-CASE WHEN p.before+p.hit>=1 THEN round(0.8/(1+exp(-0.7*(p.before+p.hit-5))),4) ELSE 0 END) AS s
  FROM step p JOIN ranked r ON r.market_id=p.market_id AND r.wallet=p.wallet AND r.rn=p.rn+1))
SELECT seq, round(s,6) AS total_score, hit=1 AS is_alert FROM step""")
def _(spark, sf):
    return scoring.recidivism_replay(frozen(spark, sf), CFG).select("seq", *rnd("total_score"), "is_alert")


# ---- labels -----------------------------------------------------------------
@query("wallet_positions", f"SELECT market_id, wallet, {r('net_shares net_cost notional gross_buy', 3)}, trade_count FROM positions")
def _(spark, sf):
    return rounded(labels.wallet_positions(tape(spark, sf)), 3)


@query("wallet_pnl", f"""
SELECT market_id, wallet, winner, {r('payout net_cost total_notional gross_buy net_pnl', 3)}, trade_count, {r('wallet_return informed_score', 5)} FROM pnl""")
def _(spark, sf):
    df = labels.wallet_pnl(tape(spark, sf), winners(spark, sf), CFG["labels"]["min_wallet_notional"])
    return rounded(rounded(df, 3, ("wallet_return", "informed_score")), 5)


@query("wallet_labels", f"SELECT market_id, wallet, {r('wallet_return label_mean label_std z_score', 5)}, is_insider FROM truth")
def _(spark, sf):
    return truth(spark, sf).select("market_id", "wallet", *rnd("wallet_return", "label_mean", "label_std", "z_score", digits=5), "is_insider")


@query("infer_resolution", f"""
SELECT m.market_id, m.market_slug, w.winner, coalesce(n,0) AS n_trades, latest AS latest_trade_ts_ms,
 CASE WHEN n IS NULL THEN 'no_trades' WHEN w.winner IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM markets m LEFT JOIN winners w USING (market_id)
LEFT JOIN (SELECT market_id, count(*) AS n, max(timestamp_ms) AS latest FROM tape GROUP BY 1) c USING (market_id)""")
def _(spark, sf):
    df = labels.resolution_table(tape(spark, sf), tables.markets(spark, sf), RESOLUTION_THRESHOLD)
    return df.select("market_id", "market_slug", "winner", "n_trades", "latest_trade_ts_ms", "status")


@query("buy_resolution_return", f"SELECT seq, is_win, {r('trade_return')} FROM buys")
def _(spark, sf):
    return labels.buy_returns(tape(spark, sf), winners(spark, sf)).select("seq", "is_win", *rnd("trade_return"))


@query("buy_resolution_pnl", f"SELECT seq, {r('payout pnl', 4)}, {r('pnl_return')} FROM buys")
def _(spark, sf):
    return labels.buy_returns(tape(spark, sf), winners(spark, sf)).select(
        "seq", *rnd("payout", "pnl", digits=4), *rnd("pnl_return"))


@query("market_ground_truth", """
SELECT market_id, count(*) AS wallets, count_if(is_insider) AS insiders, round(min(label_mean),5) AS label_mean FROM truth GROUP BY 1""")
def _(spark, sf):
    return truth(spark, sf).groupBy("market_id").agg(
        F.count(F.lit(1)).alias("wallets"), F.count_if("is_insider").alias("insiders"),
        F.round(F.min("label_mean"), 5).alias("label_mean"))


# ---- evaluations ------------------------------------------------------------
@query("wallet_evaluations", f"""
SELECT market_id, wallet, {r('suspicion flag_rate', 5)}, num_flags, has_alert, trade_count, {r('net_pnl gross_buy', 3)}, {r('wallet_return z_score', 5)}, is_insider FROM evals""")
def _(spark, sf):
    return evaluations(spark, sf).select(
        "market_id", "wallet", *rnd("suspicion", "flag_rate", digits=5), "num_flags", "has_alert", "trade_count",
        *rnd("net_pnl", "gross_buy", digits=3), *rnd("wallet_return", "z_score", digits=5), "is_insider")


@query("detector_breakdown", """
SELECT market_id, wallet, string_agg(detector||'='||n, ',' ORDER BY detector) AS detectors FROM (
 SELECT market_id, wallet, detector, count(*) AS n FROM (SELECT market_id, wallet, unnest(flag_list) AS detector FROM (
  SELECT market_id, wallet, list_filter([CASE WHEN conf_volume_anomaly>0 THEN 'volume_anomaly' END, CASE WHEN conf_probability_impact>0 THEN 'probability_impact' END,
  CASE WHEN conf_accumulation>0 THEN 'accumulation' END, CASE WHEN conf_extreme_position>0 THEN 'extreme_position' END,
  CASE WHEN conf_contra_silence>0 THEN 'contra_silence' END], lambda x: x IS NOT NULL) AS flag_list FROM scored WHERE is_alert)) GROUP BY 1,2,3) GROUP BY 1,2""")
def _(spark, sf):
    df = evaluation.detector_breakdown(frozen(spark, sf))
    text = F.concat_ws(",", F.transform(F.map_entries("detectors"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return df.select("market_id", "wallet", text.alias("detectors"))


@query("predict_wallets", f"""
SELECT market_id, wallet, num_flags>0 AS by_alert, suspicion>=1.0 AS by_suspicion, flag_rate>={FLAG_RATE} AS by_flag_rate FROM evals""")
def _(spark, sf):
    return evaluations(spark, sf).select(
        "market_id", "wallet", evaluation.predict("has_alert").alias("by_alert"),
        evaluation.predict("suspicion_threshold", 1.0).alias("by_suspicion"),
        evaluation.predict("flag_rate", flag_rate_threshold=FLAG_RATE).alias("by_flag_rate"))


METRICS_SQL = """
SELECT count(*) AS num_wallets, count_if(predicted) AS num_predicted, count_if(is_insider) AS num_insiders,
 count_if(predicted AND is_insider) AS tp, count_if(predicted AND NOT is_insider) AS fp, count_if(NOT predicted AND is_insider) AS fn,
 count_if(NOT predicted AND NOT is_insider) AS tn,
 coalesce(avg(net_pnl) FILTER (predicted),0) AS mean_net_pnl_flagged, coalesce(avg(wallet_return) FILTER (predicted),0) AS mean_return_flagged,
 coalesce(median(net_pnl) FILTER (predicted),0) AS median_net_pnl_flagged, coalesce(median(wallet_return) FILTER (predicted),0) AS median_return_flagged,
 coalesce(median(informed_score) FILTER (predicted),0) AS median_informed_score_flagged FROM evals"""
FSCORES_SQL = """coalesce(tp/nullif(tp+fp,0),0) AS precision, coalesce(tp/nullif(tp+fn,0),0) AS recall,
 coalesce(2*tp/nullif(2*tp+fn+fp,0),0) AS f1, coalesce(1.25*tp/nullif(1.25*tp+0.25*fn+fp,0),0) AS f0_5, coalesce(5*tp/nullif(5*tp+4*fn+fp,0),0) AS f2"""


@query("classification_metrics", f"""
SELECT num_wallets, num_predicted, num_insiders, tp, fp, fn, tn, {r('mean_net_pnl_flagged median_net_pnl_flagged', 2)},
 {r('mean_return_flagged median_return_flagged median_informed_score_flagged precision recall f1 f0_5 f2', 5)}
FROM (SELECT *, {FSCORES_SQL} FROM ({METRICS_SQL}))""")
def _(spark, sf):
    df = evaluation.classification_metrics(predicted(spark, sf))
    return rounded(rounded(df, 2, [c for c in df.columns if "pnl" not in c]), 5)


COHORTS_SQL = """SELECT *, unnest(CASE WHEN predicted AND is_insider THEN ['flagged','tp'] WHEN predicted THEN ['flagged','fp'] WHEN is_insider THEN ['fn'] ELSE [] END) AS cohort FROM evals"""


@query("cohort_report", f"""
SELECT cohort, count(*) AS count, round(avg(wallet_return),5) AS avg_return, round(median(wallet_return),5) AS median_return,
 round(sum(wallet_return*gross_buy)/sum(gross_buy),5) AS weighted_return, round(avg(net_pnl),2) AS avg_net_pnl, round(median(net_pnl),2) AS median_net_pnl,
 round(sum(gross_buy),2) AS total_gross_buy FROM ({COHORTS_SQL}) GROUP BY 1""")
def _(spark, sf):
    df = evaluation.cohort_report(predicted(spark, sf))
    return rounded(rounded(df, 2, ("avg_return", "median_return", "weighted_return")), 5)


@query("market_report", """
SELECT market_id, count_if(predicted) AS flagged_wallets, count_if(is_insider) AS insider_wallets, count_if(predicted AND is_insider) AS tp,
 count_if(predicted AND NOT is_insider) AS fp, count_if(NOT predicted AND is_insider) AS fn,
 round(coalesce(count_if(predicted AND is_insider)/nullif(count_if(predicted),0),0),5) AS precision,
 round(coalesce(count_if(predicted AND is_insider)/nullif(count_if(is_insider),0),0),5) AS recall,
 round(coalesce(avg(wallet_return) FILTER (predicted),0),5) AS flagged_avg_return,
 round(coalesce(sum(wallet_return*gross_buy) FILTER (predicted)/nullif(sum(gross_buy) FILTER (predicted),0),0),5) AS flagged_weighted_return,
 round(coalesce(avg(wallet_return) FILTER (predicted AND is_insider),0),5) AS tp_avg_return,
 round(coalesce(avg(wallet_return) FILTER (predicted AND NOT is_insider),0),5) AS fp_avg_return,
 round(coalesce(avg(wallet_return) FILTER (NOT predicted AND is_insider),0),5) AS fn_avg_return,
 round(coalesce(avg(net_pnl) FILTER (predicted),0),2) AS flagged_avg_net_pnl FROM evals GROUP BY 1""")
def _(spark, sf):
    df = evaluation.market_report(predicted(spark, sf))
    return rounded(df.withColumn("flagged_avg_net_pnl", F.round("flagged_avg_net_pnl", 2)), 5)


@query("flag_rate_sweep", f"""
SELECT threshold, num_wallets, num_predicted, tp, fp, fn, tn, {r('precision recall f1 f0_5 f2', 5)} FROM (SELECT *, {FSCORES_SQL} FROM (
 SELECT threshold, count(*) AS num_wallets, count_if(p) AS num_predicted, count_if(p AND is_insider) AS tp, count_if(p AND NOT is_insider) AS fp,
  count_if(NOT p AND is_insider) AS fn, count_if(NOT p AND NOT is_insider) AS tn
 FROM (SELECT *, flag_rate>=threshold AS p FROM evals, (SELECT CAST(i AS DOUBLE)/20 AS threshold FROM range(1,21) t(i))) GROUP BY 1))""")
def _(spark, sf):
    thr = spark.range(1, 21).select((F.col("id") / 20.0).alias("threshold"))
    df = evaluation.threshold_sweep(evaluations(spark, sf), thr)
    return rounded(df, 5)


# ---- economics --------------------------------------------------------------
@query("flagged_semi_join", "SELECT seq FROM tape JOIN flags USING (market_id, wallet, timestamp_ms)")
def _(spark, sf):
    return economics.semi_flagged(tape(spark, sf), economics.flag_keys(frozen(spark, sf))).select("seq")


@query("unflagged_anti_join", "SELECT seq FROM tape LEFT JOIN flags USING (market_id, wallet, timestamp_ms) WHERE flag_score IS NULL")
def _(spark, sf):
    return economics.semi_flagged(tape(spark, sf), economics.flag_keys(frozen(spark, sf)), keep=False).select("seq")


STUDY = ("flagged_mean_return flagged_median_return flagged_std_return unflagged_mean_return unflagged_median_return unflagged_std_return "
         "mean_return_diff cohens_d flagged_weighted_return unflagged_weighted_return flagged_win_rate unflagged_win_rate")


@query("event_study", f"""
SELECT market_id, winner, total_buy_trades, flagged_buy_trades, unflagged_buy_trades, {r('flagged_total_notional unflagged_total_notional', 2)}, {r(STUDY, 5)} FROM study_d""")
def _(spark, sf):
    df = economics.event_study(flagged_buys(spark, sf)).drop("welch_t", "welch_df", "mann_whitney_u", "mann_whitney_z")
    return rounded(rounded(df, 2, [c for c in df.columns if "notional" not in c]), 5)


@query("welch_test", f"SELECT market_id, {r('welch_t welch_df', 5)} FROM study_d")
def _(spark, sf):
    return economics.event_study(flagged_buys(spark, sf)).select("market_id", *rnd("welch_t", "welch_df", digits=5))


@query("mann_whitney", """
WITH ranked AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY market_id, trade_return)-1)/2.0) AS rk
 FROM fbuys WINDOW w AS (PARTITION BY market_id ORDER BY trade_return))
SELECT market_id, round(sum(rk) FILTER (is_flagged) - count_if(is_flagged)*(count_if(is_flagged)+1)/2.0,1) AS mann_whitney_u
FROM ranked GROUP BY 1 HAVING count_if(is_flagged)>=1 AND count_if(NOT is_flagged)>=1""")
def _(spark, sf):
    return economics.event_study(flagged_buys(spark, sf)).select("market_id", *rnd("mann_whitney_u", digits=1))


@query("event_study_p_values")
def _(spark, sf):
    return economics.with_p_values(economics.event_study(flagged_buys(spark, sf))).select(
        "market_id", *rnd("welch_t", "welch_p", "mann_whitney_u", "mann_whitney_p"))


SLICE_SQL = """count(*) AS count, round(avg(trade_return),5) AS mean_return, round(median(trade_return),5) AS median_return,
 round(sum(trade_return*notional_usdc)/sum(notional_usdc),5) AS weighted_return, round(count_if(trade_return>-0.999)/count(*),5) AS win_rate"""


@query("event_study_by_band", f"""
SELECT market_id, CASE {BANDS_SQL} END AS band, {SLICE_SQL} FROM fbuys WHERE is_flagged GROUP BY 1,2""")
def _(spark, sf):
    return rounded(economics.event_study_by_band(flagged_buys(spark, sf)), 5)


@query("event_study_by_detector", f"""
SELECT market_id, detector, {SLICE_SQL} FROM (SELECT *, unnest(flag_detectors) AS detector FROM fbuys WHERE is_flagged) GROUP BY 1,2""")
def _(spark, sf):
    return rounded(economics.event_study_by_detector(flagged_buys(spark, sf)), 5)


@query("event_study_pooled", """
SELECT count(*) AS n_markets, CAST(sum(flagged_buy_trades) AS BIGINT) AS total_flagged_trades, CAST(sum(unflagged_buy_trades) AS BIGINT) AS total_unflagged_trades,
 round(sum(flagged_total_notional),2) AS total_flagged_notional, round(sum(unflagged_total_notional),2) AS total_unflagged_notional,
 round(sum(flagged_mean_return*flagged_buy_trades)/sum(flagged_buy_trades),5) AS pooled_flagged_mean_return,
 round(sum(unflagged_mean_return*unflagged_buy_trades)/sum(unflagged_buy_trades),5) AS pooled_unflagged_mean_return,
 round(sum(flagged_weighted_return*flagged_total_notional)/sum(flagged_total_notional),5) AS pooled_flagged_weighted_return,
 round(sum(unflagged_weighted_return*unflagged_total_notional)/sum(unflagged_total_notional),5) AS pooled_unflagged_weighted_return,
 round(sum(flagged_mean_return*flagged_buy_trades)/sum(flagged_buy_trades)-sum(unflagged_mean_return*unflagged_buy_trades)/sum(unflagged_buy_trades),5) AS pooled_mean_return_diff,
 round(avg(cohens_d),5) AS mean_cohens_d FROM study_d""")
def _(spark, sf):
    df = economics.event_study_pooled(economics.event_study(flagged_buys(spark, sf)))
    return rounded(rounded(df, 2, [c for c in df.columns if "notional" not in c]), 5)


COPY_SQL = """SELECT market_id, count(*) AS flagged_buys, sum(notional_usdc) AS capital, sum(payout) AS payout, count_if(is_win) AS winning_trades,
 avg(pnl_return) AS mean_trade_return, coalesce(stddev_samp(pnl_return),0) AS std_trade_return, median(pnl_return) AS median_trade_return,
 sum(pnl_return*notional_usdc)/sum(notional_usdc) AS weighted_return FROM fbuys WHERE is_flagged GROUP BY 1"""


@query("copytrade", f"""
SELECT market_id, flagged_buys, winning_trades, flagged_buys-winning_trades AS losing_trades, {r('capital payout', 2)}, round(payout-capital,2) AS pnl,
 {r('mean_trade_return std_trade_return median_trade_return weighted_return', 5)}, round((payout-capital)/capital,5) AS roi, round(winning_trades/flagged_buys,5) AS win_rate,
 CAST(flagged_buys*100 AS DOUBLE) AS fixed_capital, round(mean_trade_return,5) AS fixed_roi, round(mean_trade_return*flagged_buys*100,2) AS fixed_pnl,
 round(median_trade_return,5) AS fixed_median_return FROM ({COPY_SQL})""")
def _(spark, sf):
    df = economics.copytrade(flagged_buys(spark, sf), 100.0)
    money = ("capital", "payout", "pnl", "fixed_capital", "fixed_pnl")
    return rounded(rounded(df, 2, [c for c in df.columns if c not in money]), 5)


@query("copytrade_pooled", f"""
SELECT CAST(sum(flagged_buys) AS BIGINT) AS flagged_buys, round(sum(capital),2) AS capital, round(sum(payout),2) AS payout, CAST(sum(winning_trades) AS BIGINT) AS winning_trades,
 round(sum(mean_trade_return*flagged_buys)/sum(flagged_buys),5) AS mean_trade_return, round(median(median_trade_return),5) AS median_trade_return,
 round(sum(payout)-sum(capital),2) AS pnl, round((sum(payout)-sum(capital))/sum(capital),5) AS roi,
 CAST(sum(flagged_buys)-sum(winning_trades) AS BIGINT) AS losing_trades, round(sum(winning_trades)/sum(flagged_buys),5) AS win_rate FROM ({COPY_SQL})""")
def _(spark, sf):
    df = economics.copytrade_pooled(economics.copytrade(flagged_buys(spark, sf)))
    return rounded(rounded(df, 2, [c for c in df.columns if c not in ("capital", "payout", "pnl")]), 5)


def metrics_sql(value="trade_return", source="fbuys"):
    side = "SELECT " + ", ".join(
        f"count(*) FILTER ({c}) AS {p}n, avg(x) FILTER ({c}) AS {p}m, var_samp(x) FILTER ({c}) AS {p}v, sum(w) FILTER ({c}) AS {p}w, "
        f"sum(w*w) FILTER ({c}) AS {p}ww, sum(w*x) FILTER ({c})/sum(w) FILTER ({c}) AS {p}wm, "
        f"sum(w*x*x) FILTER ({c})/sum(w) FILTER ({c}) - (sum(w*x) FILTER ({c})/sum(w) FILTER ({c}))**2 AS {p}wv, count(*) FILTER (({c}) AND x>0) AS {p}pos"
        for p, c in (("f", "is_flagged"), ("u", "NOT is_flagged"))) + f" FROM (SELECT is_flagged, {value} AS x, notional_usdc AS w FROM {source})"
    return (f"SELECT *, (fm-um)/sqrt(((fn-1)*fv+(un-1)*uv)/(fn+un-2)) AS d, (fwm-uwm)/sqrt(((fn-1)*fwv+(un-1)*uwv)/(fn+un-2)) AS wd, "
            f"fw*fw/fww AS fe, uw*uw/uww AS ue FROM ({side})")


@query("trade_metrics", f"""
SELECT fn AS trade_flagged_count, un AS trade_unflagged_count, round(fm,5) AS trade_flagged_mean_return, round(um,5) AS trade_unflagged_mean_return,
 round(sqrt(fv/fn),5) AS trade_flagged_mean_return_se, round(fm-1.64*sqrt(fv/fn),5) AS trade_flagged_mean_return_lcb, round(fm-um,5) AS trade_mean_return_diff,
 round((fm-um)/sqrt(fv/fn+uv/un),5) AS trade_t_stat, round(d,5) AS trade_cohens_d, round(sqrt((fn+un)/(fn*un)+d*d/(2*(fn+un-2))),5) AS trade_cohens_d_se,
 round(d-1.64*sqrt((fn+un)/(fn*un)+d*d/(2*(fn+un-2))),5) AS trade_cohens_d_lcb, round(fpos/fn,5) AS trade_flagged_win_rate,
 round(fwm,5) AS trade_flagged_weighted_return, round(sqrt(fwv/fe),5) AS trade_flagged_weighted_return_se, round(fwm-1.64*sqrt(fwv/fe),5) AS trade_flagged_weighted_return_lcb,
 round(fwm-uwm,5) AS trade_weighted_mean_return_diff, round(wd,5) AS trade_weighted_cohens_d, round(sqrt((fe+ue)/(fe*ue)+wd*wd/(2*(fe+ue-2))),5) AS trade_weighted_cohens_d_se,
 round(wd-1.64*sqrt((fe+ue)/(fe*ue)+wd*wd/(2*(fe+ue-2))),5) AS trade_weighted_cohens_d_lcb, round(fe,4) AS trade_flagged_effective_count, round(ue,4) AS trade_unflagged_effective_count
FROM ({metrics_sql()})""")
def _(spark, sf):
    df = economics.trade_metrics(flagged_buys(spark, sf))
    return rounded(rounded(df, 4, [c for c in df.columns if "effective" not in c]), 5)


WINSOR_SQL = """(SELECT is_flagged, notional_usdc, greatest(lo,least(hi,trade_return)) AS trade_return FROM fbuys JOIN
 (SELECT is_flagged, quantile_cont(trade_return,0.05) AS lo, quantile_cont(trade_return,0.95) AS hi FROM fbuys GROUP BY 1) USING (is_flagged))"""


@query("winsorized_metrics", f"""
SELECT round(fm-um,5) AS trade_winsorized_mean_return_diff, round(d,5) AS trade_winsorized_cohens_d, round(fwm-uwm,5) AS trade_winsorized_weighted_mean_return_diff,
 round(wd,5) AS trade_winsorized_weighted_cohens_d, round(sqrt((fe+ue)/(fe*ue)+wd*wd/(2*(fe+ue-2))),5) AS trade_winsorized_weighted_cohens_d_se,
 round(wd-1.64*sqrt((fe+ue)/(fe*ue)+wd*wd/(2*(fe+ue-2))),5) AS trade_winsorized_weighted_cohens_d_lcb FROM ({metrics_sql(source=WINSOR_SQL)})""")
def _(spark, sf):
    return rounded(economics.winsorized_metrics(flagged_buys(spark, sf)), 5)


def all_metrics(spark, sf, signals):
    wallet = evaluation.classification_metrics(predicted(spark, sf, signals))
    trade = economics.trade_metrics(flagged_buys(spark, sf, signals))
    return wallet.crossJoin(trade)


def _fb(e, s):
    return f"CASE WHEN {e}>0 AND {s}>0 THEN 2*{e}*{s}/({e}+{s}) ELSE 0 END"


@query("econ_fbeta", f"""
WITH m AS (SELECT *, {FSCORES_SQL} FROM ({METRICS_SQL})), t AS (SELECT * FROM ({metrics_sql()})),
s AS (SELECT recall, f1, f0_5, least(1,greatest(0,fpos/fn)) AS win, least(1,greatest(0,mean_return_flagged)) AS mean,
 greatest(0,tanh(mean_return_flagged/2)) AS soft, greatest(0,tanh(fm/2)) AS tsoft, greatest(0,tanh((fm-um)/sqrt(fv/t.fn+uv/un)/4)) AS t
 FROM (SELECT tp, recall, f1, f0_5, mean_return_flagged FROM m), t)
SELECT round(win,5) AS econ_signal_winrate, round(mean,5) AS econ_signal_mean_return, round(soft,5) AS econ_signal_return_sigmoid,
 round(tsoft,5) AS econ_signal_trade_return_sigmoid, round(t,5) AS econ_signal_t_stat, round({_fb('win','recall')},5) AS f_beta_winrate,
 round({_fb('mean','recall')},5) AS f_beta_mean_return, round({_fb('win','f1')},5) AS f_beta_winrate_f1, round({_fb('mean','f1')},5) AS f_beta_mean_return_f1,
 round({_fb('soft','f1')},5) AS f_beta_return_f1, round({_fb('t','f1')},5) AS f_beta_t_stat_f1, round({_fb('win','f0_5')},5) AS f_beta_winrate_f0_5,
 round({_fb('mean','f0_5')},5) AS f_beta_mean_return_f0_5, round({_fb('win','tsoft')},5) AS f_beta_winrate_return FROM s""")
def _(spark, sf):
    df = economics.econ_fbeta(all_metrics(spark, sf, frozen(spark, sf)))
    return rounded(df.select(*[c for c in df.columns if c.startswith(("econ_", "f_beta"))]), 5)


@query("quality_composite", f"""
SELECT round(f0_5,5) AS f0_5, round(median_net_pnl_flagged,2) AS median_net_pnl_flagged, round(f0_5*tanh(median_net_pnl_flagged/100),5) AS quality
FROM (SELECT *, {FSCORES_SQL} FROM ({METRICS_SQL}))""")
def _(spark, sf):
    df = economics.quality_composite(evaluation.classification_metrics(predicted(spark, sf)))
    return df.select(*rnd("f0_5", digits=5), *rnd("median_net_pnl_flagged", digits=2), *rnd("quality", digits=5))
