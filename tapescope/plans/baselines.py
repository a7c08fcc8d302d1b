"""Queries over the published baselines."""

from pyspark.sql import functions as F

from tapescope.operators import baselines, economics, scoring
from tapescope.plans.base import CFG, FLAG_RATE, frozen, rnd, tape, truth, winners
from tapescope.plans.evaluate import FSCORES_SQL, r, rounded
from tapescope.plans.registry import query, view
from tapescope.sources import tables


def close(spark, sf):
    return tables.markets(spark, sf).where("close_ms is not null").select("market_id", "close_ms")


view("timing", """
SELECT t.market_id, t.seq, t.wallet, t.timestamp_ms FROM (SELECT *, count(*) OVER (PARTITION BY market_id, wallet ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS here FROM tape) t
JOIN (SELECT p.market_id, p.wallet, count(x.seq) AS prior FROM (SELECT DISTINCT market_id, wallet FROM tape) p JOIN (SELECT market_id, min(timestamp_ms) AS f FROM tape GROUP BY 1) f USING (market_id)
  LEFT JOIN tape x ON x.wallet=p.wallet AND x.timestamp_ms<f.f GROUP BY 1,2) p ON p.market_id=t.market_id AND p.wallet=t.wallet
JOIN markets m ON m.market_id=t.market_id WHERE here+prior<=3 AND side='BUY' AND notional_usdc>=1000 AND close_ms-timestamp_ms BETWEEN 0 AND 336*3600000""")


def timing(spark, sf):
    return baselines.timing_heuristic(tape(spark, sf), close(spark, sf), 3, 1000.0, 336.0)


@query("timing_heuristic", "SELECT market_id, seq, wallet FROM timing")
def _(spark, sf):
    return timing(spark, sf).select("market_id", "seq", "wallet")


view("pairs", """
SELECT b.market_id, b.wallet, sum(notional_usdc) AS bn, sum(payout) AS win_tokens, count(*) AS n_buys,
 greatest(sum(CASE WHEN outcome_index=0 THEN notional_usdc ELSE 0 END),sum(CASE WHEN outcome_index=1 THEN notional_usdc ELSE 0 END)) AS top,
 sum(CASE WHEN timestamp_ms<jump_ts THEN notional_usdc ELSE 0 END) AS early
FROM buys b LEFT JOIN (SELECT market_id, arg_max(timestamp_ms,(rise,-timestamp_ms,-seq)) AS jump_ts FROM (
 SELECT t.market_id, timestamp_ms, seq, price-lag(price) OVER (PARTITION BY t.market_id ORDER BY timestamp_ms, seq) AS rise FROM tape t JOIN winners w ON w.market_id=t.market_id AND w.winner=t.outcome_index) WHERE rise IS NOT NULL GROUP BY 1) j ON j.market_id=b.market_id
GROUP BY 1,2 HAVING sum(notional_usdc)>=500""")
view("psig", """
SELECT market_id, wallet, bn, n_buys, ln(1+bn) AS s1, CASE WHEN count(*) OVER w>=2 AND stddev_samp(bn) OVER w>=1e-12 THEN (bn-avg(bn) OVER w)/stddev_samp(bn) OVER w ELSE 0 END AS s2,
 (win_tokens-bn)/bn AS s3, coalesce(early,0)/bn AS s4, top/bn AS s5 FROM pairs WINDOW w AS (PARTITION BY wallet)""")
view("pcomp", "SELECT market_id, wallet, bn, n_buys, " + "+".join(
    f"(CASE WHEN stddev_samp(s{i}) OVER ()>=1e-12 THEN (s{i}-avg(s{i}) OVER ())/stddev_samp(s{i}) OVER () ELSE 0 END)" for i in range(1, 6)) + " AS composite FROM psig")


@query("size_profit_screen", f"SELECT market_id, wallet, n_buys, {r('composite', 5)} FROM pcomp")
def _(spark, sf):
    df = baselines.size_profit_screen(tape(spark, sf), winners(spark, sf))
    return df.select("market_id", "wallet", "n_buys", *rnd("composite", digits=5))


def _pz(col, part=""):
    w = f"({part} ORDER BY cutoff, market_id, wallet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) OVER {w}>=2 AND stddev_samp({col}) OVER {w}>=1e-12 THEN ({col}-avg({col}) OVER {w})/stddev_samp({col}) OVER {w} ELSE 0 END"


@query("size_timing_screen", f"""
WITH p AS (SELECT b.market_id, wallet, sum(notional_usdc) AS bn, max(timestamp_ms) AS cutoff, count(*) AS n_buys, sum(CASE WHEN price<=0.3 THEN notional_usdc ELSE 0 END) AS low,
 sum((close_ms-timestamp_ms)/3600000.0*notional_usdc) AS hrs, greatest(sum(CASE WHEN outcome_index=0 THEN notional_usdc ELSE 0 END),sum(CASE WHEN outcome_index=1 THEN notional_usdc ELSE 0 END)) AS top
 FROM buys b JOIN markets m ON m.market_id=b.market_id WHERE timestamp_ms<close_ms GROUP BY 1,2 HAVING sum(notional_usdc)>=500),
s AS (SELECT *, ln(1+bn) AS s1, low/bn*greatest(hrs/bn,0) AS s4, top/bn AS s5 FROM p)
SELECT market_id, wallet, n_buys, cutoff, round({_pz('s1')}+{_pz('bn','PARTITION BY wallet')}+{_pz('s4')}+{_pz('s5')},4) AS composite FROM s""")
def _(spark, sf):
    df = baselines.size_timing_screen(tape(spark, sf), winners(spark, sf), close(spark, sf))
    return df.select("market_id", "wallet", "n_buys", "cutoff", *rnd("composite", digits=4))


@query("pair_selection", "SELECT market_id, wallet FROM (SELECT *, row_number() OVER (ORDER BY round(composite,9) DESC, market_id, wallet) AS rn, count(*) OVER () AS n FROM pcomp) WHERE rn<=greatest(1,round_even(n*0.05,0))")
def _(spark, sf):
    p = baselines.size_profit_screen(tape(spark, sf), winners(spark, sf)).withColumn("composite", F.round("composite", 9))
    return baselines.select_top_percent(p, 5.0).select("market_id", "wallet")


@query("select_until_target", "SELECT market_id, wallet FROM (SELECT *, coalesce(sum(n_buys) OVER (ORDER BY round(composite,9) DESC, market_id, wallet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS taken FROM pcomp) WHERE taken<300")
def _(spark, sf):
    p = baselines.size_profit_screen(tape(spark, sf), winners(spark, sf)).withColumn("composite", F.round("composite", 9))
    return baselines.select_until_target(p, F.lit(300)).select("market_id", "wallet")


@query("position_trajectories", """
WITH t AS (SELECT tape.*, winner, timestamp_ms//86400000 AS b FROM tape JOIN winners USING (market_id)), g AS (SELECT market_id, min(b) AS b0, max(b) AS b1 FROM t GROUP BY 1 HAVING max(b)>min(b)),
e AS (SELECT market_id, wallet FROM t GROUP BY 1,2 HAVING sum(notional_usdc)>=500),
d AS (SELECT market_id, wallet, b, sum(CASE WHEN side='BUY' THEN size_tokens ELSE -size_tokens END) AS d FROM t JOIN e USING (market_id, wallet) WHERE outcome_index=winner GROUP BY 1,2,3),
x AS (SELECT w.market_id, w.wallet, gb.b, coalesce(d.d,0) AS d, sum(coalesce(d.d,0)) OVER (PARTITION BY w.market_id, w.wallet ORDER BY gb.b) AS cum FROM (SELECT DISTINCT market_id, wallet FROM d) w JOIN g USING (market_id), LATERAL (SELECT unnest(range(b0,b1+1)) AS b) gb LEFT JOIN d ON d.market_id=w.market_id AND d.wallet=w.wallet AND d.b=gb.b)
SELECT market_id, wallet, count_if(abs(d)>1e-12) AS d_active, count(*) AS t, round(sum(cum)/max(abs(cum)),4) AS area, round(arg_max(cum,b)/max(abs(cum)),5) AS final FROM x GROUP BY 1,2 HAVING max(abs(cum))>=1e-12""")
def _(spark, sf):
    p = baselines.trajectories(tape(spark, sf), winners(spark, sf), 24)
    return p.select("market_id", "wallet", "d_active", F.size("x").cast("long").alias("t"),
                    F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("area"), F.round(F.element_at("x", -1), 5).alias("final"))


@query("trajectory_pca_screen")
def _(spark, sf):
    return rounded(baselines.trajectory_screen(tape(spark, sf), winners(spark, sf), close(spark, sf), 24, 96), 5)


@query("bimodal_trough", """
WITH v AS (SELECT market_id, round(flag_rate,9) AS v FROM evals), s AS (SELECT market_id, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi, quantile_cont(v,0.9) AS pct FROM v GROUP BY 1),
g AS (SELECT *, lo+(hi-lo)*i/255.0 AS pt, sd*pow(n,-0.2) AS h FROM s, range(0,256) t(i) WHERE n>=8 AND hi-lo>=1e-12),
d AS (SELECT g.market_id, i, pt, sum(exp(-0.5*pow((pt-v.v)/h,2))) AS d FROM g JOIN v ON v.market_id=g.market_id GROUP BY 1,2,3),
p AS (SELECT *, d>lag(d) OVER w AND d>lead(d) OVER w AS pk FROM d WINDOW w AS (PARTITION BY market_id ORDER BY i)),
k AS (SELECT market_id, min(i) AS a, max(i) AS b FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY d DESC, i) AS rn FROM p WHERE pk) WHERE rn<=2 GROUP BY 1 HAVING count(*)=2),
t AS (SELECT d.market_id, arg_min(pt,(d,i)) AS trough FROM d JOIN k ON k.market_id=d.market_id AND i BETWEEN a AND b GROUP BY 1)
SELECT market_id, round(coalesce(trough,pct),5) AS eps, CASE WHEN trough IS NULL THEN 'percentile_fallback' ELSE 'bimodal_trough' END AS rule FROM s LEFT JOIN t USING (market_id)""")
def _(spark, sf):
    from tapescope.plans.base import evaluations
    from tapescope.session import cut
    e = cut(evaluations(spark, sf).select("market_id", F.round("flag_rate", 9).alias("s_star")))
    return rounded(baselines.bimodal_trough(e), 5)


@query("anomaly_features", """
SELECT seq, round(ln(notional_usdc+1),6) AS log_notional, round(price,6) AS price, CAST(side='BUY' AS DOUBLE) AS is_buy, CAST(count(*) OVER w AS DOUBLE) AS wallet_prior_trades,
 round(coalesce(sum(notional_usdc) OVER w,0),4) AS wallet_prior_notional, CAST(close_ms-timestamp_ms AS DOUBLE) AS ms_to_close, CAST(count(*) OVER m AS DOUBLE) AS market_prior_trades
FROM tape JOIN (SELECT market_id, close_ms FROM markets) k USING (market_id) WINDOW w AS (PARTITION BY wallet ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m AS (PARTITION BY market_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    df = baselines.anomaly_features(tape(spark, sf), close(spark, sf))
    return df.select("seq", *rnd("log_notional", "price"), "is_buy", "wallet_prior_trades", *rnd("wallet_prior_notional", digits=4), F.round(F.col("hours_to_close") * 3_600_000.0).alias("ms_to_close"), "market_prior_trades")


@query("isolation_forest")
def _(spark, sf):
    df = baselines.isolation_forest(baselines.anomaly_features(tape(spark, sf), close(spark, sf)), 100)
    return df.select("seq", *rnd("anomaly"), (F.col("anomaly") < 0).alias("is_flagged"))


@query("matched_threshold", "SELECT round(x,5) AS threshold FROM (SELECT -round(base_score,9) AS x, row_number() OVER (ORDER BY -round(base_score,9), seq) AS rn, count(*) OVER () AS n FROM scored WHERE side='BUY') WHERE rn=greatest(1,round_even(n*0.1,0))")
def _(spark, sf):
    s = frozen(spark, sf).withColumn("anomaly", -F.round("base_score", 9))
    return rounded(baselines.matched_threshold(s, 0.1), 5)


@query("random_baseline", """
SELECT trial, count_if(f) AS flagged, count_if(NOT f) AS unflagged, round(avg(trade_return) FILTER (f)-avg(trade_return) FILTER (NOT f),5) AS mean_return_diff,
 round((avg(trade_return) FILTER (f)-avg(trade_return) FILTER (NOT f))/sqrt(((count_if(f)-1)*var_samp(trade_return) FILTER (f)+(count_if(NOT f)-1)*var_samp(trade_return) FILTER (NOT f))/(count(*)-2)),5) AS cohens_d,
 round(sum(trade_return*notional_usdc) FILTER (f)/sum(notional_usdc) FILTER (f),5) AS roi
FROM (SELECT *, (seq*7919+(trial+1)*104729+(seq % 1009)*(seq % 1013)*31) % 10007 < 1000 AS f FROM buys, (SELECT unnest(range(0,5)) AS trial) k) GROUP BY 1""")
def _(spark, sf):
    from tapescope.operators import labels
    return rounded(baselines.random_baseline(labels.buy_returns(tape(spark, sf), winners(spark, sf)), 0.1, 5), 5)


@query("baseline_metrics", """
WITH b AS (SELECT b.*, t.seq IS NOT NULL AS f FROM buys b LEFT JOIN (SELECT DISTINCT market_id, wallet, timestamp_ms, min(seq) OVER (PARTITION BY market_id, wallet, timestamp_ms) AS seq FROM timing) t USING (market_id, wallet, timestamp_ms)),
w AS (SELECT DISTINCT market_id, wallet, true AS fw FROM b WHERE f)
SELECT (SELECT count_if(f) FROM b) AS flagged_trades, (SELECT count_if(NOT f) FROM b) AS unflagged_trades, (SELECT round(avg(trade_return) FILTER (f)-avg(trade_return) FILTER (NOT f),5) FROM b) AS mean_return_diff,
 (SELECT round(sum(trade_return*notional_usdc) FILTER (f)/sum(notional_usdc) FILTER (f),5) FROM b) AS copytrade_roi,
 count_if(coalesce(fw,false) AND is_insider) AS tp, count_if(coalesce(fw,false) AND NOT is_insider) AS fp, count_if(NOT coalesce(fw,false) AND is_insider) AS fn FROM truth LEFT JOIN w USING (market_id, wallet)""")
def _(spark, sf):
    flags = timing(spark, sf).groupBy(*economics.FLAG_KEY).agg(F.lit(1.0).alias("flag_score")).withColumn("flag_detectors", F.array(F.lit("timing")))
    buys = economics.flagged_buys(tape(spark, sf), winners(spark, sf), flags)
    return rounded(baselines.baseline_metrics(buys, truth(spark, sf)), 5)


@query("flag_state", "SELECT 'timing' AS method, t.market_id, t.wallet, count(*) AS num_flags, true AS any_flag, count(*)/any_value(p.trade_count)>=0.5 AS classified FROM timing t JOIN positions p ON p.market_id=t.market_id AND p.wallet=t.wallet GROUP BY 2,3")
def _(spark, sf):
    return baselines.flag_state(timing(spark, sf), tape(spark, sf), "timing")


@query("method_comparison", f"""
WITH m AS (SELECT 'system' AS method, count_if(predicted AND is_insider) AS tp, count_if(predicted AND NOT is_insider) AS fp, count_if(NOT predicted AND is_insider) AS fn, CAST(sum(num_flags) AS BIGINT) AS flag_volume FROM evals
 UNION ALL SELECT 'timing', count_if(coalesce(c,false) AND is_insider), count_if(coalesce(c,false) AND NOT is_insider), count_if(NOT coalesce(c,false) AND is_insider), CAST(coalesce(sum(nf),0) AS BIGINT) FROM truth
  LEFT JOIN (SELECT t.market_id, t.wallet, count(*) AS nf, count(*)/any_value(p.trade_count)>=0.5 AS c FROM timing t JOIN positions p ON p.market_id=t.market_id AND p.wallet=t.wallet GROUP BY 1,2) x USING (market_id, wallet))
SELECT method, tp, fp, fn, flag_volume, {r('precision recall f1 f0_5 f2', 5)} FROM (SELECT *, {FSCORES_SQL} FROM m)""")
def _(spark, sf):
    s = scoring.wallet_suspicion(frozen(spark, sf))
    system = s.select(F.lit("system").alias("method"), "market_id", "wallet", "num_flags", (F.col("num_flags") > 0).alias("any_flag"),
                      (F.col("num_flags") / F.col("trade_count") >= FLAG_RATE).alias("classified"))
    states = system.unionByName(baselines.flag_state(timing(spark, sf), tape(spark, sf), "timing"))
    return rounded(baselines.method_comparison(states, truth(spark, sf)), 5)


@query("baseline_runs", "SELECT 'timing' AS method, count(*) AS flagged_trades, count(DISTINCT wallet) AS flagged_wallets, count(DISTINCT market_id) AS markets FROM timing")
def _(spark, sf):
    return timing(spark, sf).agg(F.lit("timing").alias("method"), F.count(F.lit(1)).alias("flagged_trades"), F.countDistinct("wallet").alias("flagged_wallets"),
                                 F.countDistinct("market_id").alias("markets"))
