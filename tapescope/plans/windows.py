"""Queries over running state and the tape detectors."""

from pyspark.sql import functions as F

from tapescope.operators import detectors as det
from tapescope.operators import scoring, state
from tapescope.plans.base import CFG, rnd, scored, tape
from tapescope.plans.registry import query


@query("rolling_stats", """
SELECT seq, CAST(base_n AS BIGINT) AS base_n, round(base_mean,4) AS base_mean, round(base_std,4) AS base_std FROM baseline""")
def _(spark, sf):
    t = tape(spark, sf)
    return state.rolling_stats(state.market_state(t), t).select("seq", "base_n", *rnd("base_mean", "base_std", digits=4))


@query("wallet_state_running", """
SELECT seq, w_trades, round(w_volume,4) AS w_volume, w_first_ts, round(w_shares0,3) AS w_shares0, round(w_shares1,3) AS w_shares1,
 round(w_vol0,4) AS w_vol0, round(w_vol1,4) AS w_vol1, round(w_price0,6) AS w_price0, round(w_price1,6) AS w_price1 FROM wstate""")
def _(spark, sf):
    df = state.wallet_state(tape(spark, sf)).withColumns({
        "w_vol0": F.col("w_buy0") + F.col("w_sell0"), "w_vol1": F.col("w_buy1") + F.col("w_sell1")})
    return df.select("seq", "w_trades", "w_first_ts", *rnd("w_volume", "w_vol0", "w_vol1", digits=4),
                     *rnd("w_shares0", "w_shares1", digits=3), *rnd("w_price0", "w_price1"))


@query("wallet_ratios", """
SELECT seq, round(net_exposure,3) AS net_exposure, round(directional_ratio,6) AS directional_ratio,
 round(outcome_exposure,3) AS outcome_exposure, round(outcome_directional,6) AS outcome_directional,
 round(outcome_concentration,6) AS outcome_concentration, is_hedged FROM wratio""")
def _(spark, sf):
    df = state.wallet_ratios(state.wallet_state(tape(spark, sf)))
    return df.select("seq", *rnd("net_exposure", "outcome_exposure", digits=3),
                     *rnd("directional_ratio", "outcome_directional", "outcome_concentration"), "is_hedged")


@query("last_price_lag", """
SELECT seq, market_id, round(lag(price) OVER (PARTITION BY market_id, outcome_index ORDER BY timestamp_ms, seq),6) AS prev_price FROM tape""")
def _(spark, sf):
    return state.market_state(tape(spark, sf)).select("seq", "market_id", *rnd("prev_price"))


@query("outcome_gap_median", """
SELECT seq, market_id, outcome_index, gap_ms, round(gap_median,1) AS gap_median, gap_n FROM gapmed""")
def _(spark, sf):
    return state.gap_medians(tape(spark, sf)).select(
        "seq", "market_id", "outcome_index", "gap_ms", *rnd("gap_median", digits=1), "gap_n")


@query("contra_asof", """
SELECT seq, contra_ts, round(contra_gap_median,1) AS contra_gap_median, CAST(coalesce(contra_gap_n,0) AS BIGINT) AS contra_gap_n
FROM mstate LEFT JOIN contragap USING (seq)""")
def _(spark, sf):
    t = tape(spark, sf)
    df = state.contra_gaps(state.market_state(t), t)
    return df.select("seq", "contra_ts", *rnd("contra_gap_median", digits=1), "contra_gap_n")


@query("prior_counts", """
SELECT seq, count(*) OVER w AS wallet_prior_trades, round(coalesce(sum(notional_usdc) OVER w,0),4) AS wallet_prior_notional,
 round(CASE WHEN sum(notional_usdc) OVER w>0 THEN coalesce(sum(notional_usdc) OVER wm,0)/sum(notional_usdc) OVER w ELSE 0 END,6) AS wallet_market_share,
 count(*) OVER m AS market_prior_trades
FROM tape WINDOW
 w AS (PARTITION BY wallet ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 wm AS (PARTITION BY wallet, market_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 m AS (PARTITION BY market_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return state.prior_counts(tape(spark, sf)).select(
        "seq", "wallet_prior_trades", *rnd("wallet_prior_notional", digits=4), *rnd("wallet_market_share"),
        "market_prior_trades")


@query("expanding_zscore", """
SELECT seq, round(CASE WHEN count(*) OVER g>=2 AND stddev_samp(x) OVER g>=1e-12 THEN (x-avg(x) OVER g)/stddev_samp(x) OVER g ELSE 0 END,5) AS z_all,
 round(CASE WHEN count(*) OVER w>=2 AND stddev_samp(x) OVER w>=1e-12 THEN (x-avg(x) OVER w)/stddev_samp(x) OVER w ELSE 0 END,5) AS z_wallet
FROM (SELECT *, ln(1+notional_usdc) AS x FROM tape) WINDOW
 g AS (ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 w AS (PARTITION BY wallet ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    x = F.log1p("notional_usdc")
    df = state.prior_zscores(tape(spark, sf), [], state.ORDER, {"z_all": x})
    return state.prior_zscores(df, ["wallet"], state.ORDER, {"z_wallet": x}).select("seq", *rnd("z_all", "z_wallet", digits=5))


@query("flipper_filter", """
SELECT seq, round(directional_ratio,6) AS directional_ratio, (w_volume>=10000 AND directional_ratio<0.5) AS is_flipper FROM wratio""")
def _(spark, sf):
    df = state.wallet_ratios(state.wallet_state(tape(spark, sf)))
    return df.select("seq", *rnd("directional_ratio"), state.is_flipper(CFG).alias("is_flipper"))


def _confidence(name, prepare):
    @query(name, f"SELECT seq, round(conf_{name},6) AS confidence FROM detected WHERE conf_{name}>0")
    def _(spark, sf):
        df = prepare(tape(spark, sf)).withColumn("confidence", det.TAPE_DETECTORS[name](CFG))
        return df.where("confidence > 0").select("seq", *rnd("confidence"))


_confidence("volume_anomaly", lambda t: state.rolling_stats(
    state.market_state(state.wallet_ratios(state.wallet_state(t)), t), t))
_confidence("probability_impact", state.market_state)
_confidence("accumulation", lambda t: state.wallet_ratios(state.wallet_state(t)))
_confidence("extreme_position", lambda t: state.wallet_ratios(state.wallet_state(t)))
_confidence("contra_silence", lambda t: state.contra_gaps(state.market_state(t), t))


@query("replay", """
SELECT seq, market_id, wallet, round(conf_volume_anomaly,6) AS conf_volume_anomaly, round(conf_probability_impact,6) AS conf_probability_impact,
 round(conf_accumulation,6) AS conf_accumulation, round(conf_extreme_position,6) AS conf_extreme_position,
 round(conf_contra_silence,6) AS conf_contra_silence, round(total_score,6) AS total_score, is_alert FROM scored""")
def _(spark, sf):
    df = scored(spark, sf)
    return df.select("seq", "market_id", "wallet", *rnd(*scoring.conf_columns(df), "total_score"), "is_alert")
