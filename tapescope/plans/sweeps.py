"""Queries over sweeps, ablations, counterfactuals, recall and search."""

import itertools

from pyspark.sql import functions as F

from tapescope.operators import causal, economics, evaluation, labels, markets, scoring, search, sweeps
from tapescope.operators.iterate import union_all
from tapescope.operators.running import DAY_MS
from tapescope.plans.base import CFG, FLAG_RATE, evaluations, flagged_buys, frozen, predicted, replay_views, rnd, tape, truth, winners
from tapescope.plans.evaluate import FSCORES_SQL, all_metrics, r, rounded
from tapescope.plans.graphs import member
from tapescope.plans.registry import query, view
from tapescope.session import cut
from tapescope.sources import tables

DETS = ["volume_anomaly", "probability_impact", "accumulation", "extreme_position", "contra_silence"]


CUTOFFS = [0.0, 500.0, 2000.0]
for _i, _c in enumerate(CUTOFFS):
    replay_views(f"_min{_i}", f"SELECT * FROM tape WHERE notional_usdc>={_c}")


@query("min_usd_sweep", " UNION ALL ".join(f"""SELECT CAST({c} AS DOUBLE) AS min_usd, count(*) AS trades, count_if(is_alert) AS alerts, count(DISTINCT wallet) AS wallets,
 round(sum(total_score),4) AS suspicion, (SELECT count(*) FROM (SELECT s.market_id, s.wallet FROM scored_min{i} s JOIN truth t ON t.market_id=s.market_id AND t.wallet=s.wallet WHERE t.is_insider
 GROUP BY 1,2 HAVING count_if(s.is_alert)/count(*)>={FLAG_RATE})) AS tp FROM scored_min{i}""" for i, c in enumerate(CUTOFFS)))
def _(spark, sf):
    """Each cut-off's replay: trades, alerts, wallets, suspicion, and the labelled wallets that its flags find."""
    s = cut(sweeps.min_notional_sweep(tape(spark, sf), CFG, CUTOFFS).select("min_usd", "market_id", "wallet", "is_alert", "total_score"))
    known = truth(spark, sf).where("is_insider").select("market_id", "wallet")
    found = s.groupBy("min_usd", "market_id", "wallet").agg((F.count_if("is_alert") / F.count(F.lit(1))).alias("rate")).where(F.col("rate") >= FLAG_RATE).join(
        known, ["market_id", "wallet"], "left_semi").groupBy("min_usd").agg(F.count(F.lit(1)).alias("tp"))
    per = s.groupBy("min_usd").agg(F.count(F.lit(1)).alias("trades"), F.count_if("is_alert").alias("alerts"), F.countDistinct("wallet").alias("wallets"),
                                   F.round(F.sum("total_score"), 4).alias("suspicion"))
    return per.join(found, "min_usd", "left").fillna(0, ["tp"])


def _score(drop=None):
    return "1-" + "*".join(f"(1-conf_{d})" for d in DETS if d != drop)


@query("ablation", "SELECT variant, trades, alerts, alerts-full_n AS alerts_delta FROM (" + " UNION ALL ".join(
    f"SELECT '{'full' if d is None else 'no_' + d}' AS variant, count(*) AS trades, count_if({_score(d)}>=0.5) AS alerts, count_if({_score()}>=0.5) AS full_n FROM scored"
    for d in [None, *DETS]) + ")")
def _(spark, sf):
    return sweeps.ablation(frozen(spark, sf), CFG)


FLAG_LIST = "list_filter([" + ",".join(f"CASE WHEN conf_{d}>0 THEN '{d}' END" for d in DETS) + "], lambda x: x IS NOT NULL)"


@query("detector_diagnostics", f"""
WITH f AS ({' UNION ALL '.join(f"SELECT '{d}' AS detector, count_if(conf_{d}>0) AS fires FROM scored" for d in DETS)}),
a AS (SELECT detector, count(*) AS alerts, count_if(n=1) AS alone FROM (SELECT unnest(fl) AS detector, len(fl) AS n FROM (SELECT {FLAG_LIST} AS fl FROM scored WHERE is_alert)) GROUP BY 1),
m AS (SELECT detector, count(*) AS flagged_buys, sum(pnl) AS pnl, avg(trade_return) AS mean_return FROM (SELECT *, unnest(flag_detectors) AS detector FROM fbuys WHERE is_flagged) GROUP BY 1)
SELECT detector, fires, coalesce(alerts,0) AS alerts, coalesce(alone,0) AS alone, coalesce(flagged_buys,0) AS flagged_buys, round(coalesce(pnl,0),2) AS pnl, round(coalesce(mean_return,0),5) AS mean_return FROM f LEFT JOIN a USING (detector) LEFT JOIN m USING (detector)""")
def _(spark, sf):
    s = frozen(spark, sf)
    return rounded(rounded(sweeps.detector_diagnostics(flagged_buys(spark, sf, s), s), 2, ("mean_return",)), 5)


@query("jump_diagnostics")
def _(spark, sf):
    s = causal.jump_multiplier(frozen(spark, sf), CFG)
    boosted = F.col("jump_multiplier") > 1.0
    after = scoring.boosted(F.col("base_score"), F.col("jump_multiplier"), CFG["score_cap"]) >= CFG["alert_threshold"]
    return s.groupBy("market_id").agg(F.count_if(boosted).alias("boosted_trades"), F.count_if("is_alert").alias("alerts_before"),
                                      F.count_if(after).alias("alerts_after"))


# a fixed boost per wallet stands in for the cluster multiplier where SQL must repeat it
def _mult():
    return (F.lit(1.0) + F.regexp_replace("wallet", "^0x0*(?=[0-9])", "").cast("long") % 5 * 0.1).cast("float")


view("boosted", "SELECT *, CAST(CAST(1.0+(CAST(substr(wallet,3) AS BIGINT) % 5)*0.1 AS FLOAT) AS DOUBLE) AS multiplier, least(base_score*CAST(CAST(1.0+(CAST(substr(wallet,3) AS BIGINT) % 5)*0.1 AS FLOAT) AS DOUBLE),0.95)>=0.5 AS hit FROM scored")


def counterfactual(spark, sf, s):
    b = s.withColumn("multiplier", _mult())
    hit = scoring.boosted(F.col("base_score"), F.col("multiplier"), CFG["score_cap"]) >= CFG["alert_threshold"]
    keys = ["market_id", "wallet"]
    return sweeps.wallet_counterfactual(b.groupBy(*keys).agg(F.count_if(hit).alias("num_flags")), b.groupBy(*keys).agg(F.count_if("is_alert").alias("num_flags")))


@query("clustering_counterfactual", """
SELECT decisive, bucket, count(*) AS wallets, round(sum(net_pnl),2) AS net_pnl, round(avg(wallet_return),5) AS mean_return, count_if(is_insider) AS insiders FROM (
 SELECT t.*, CAST(w AS VARCHAR) AS decisive, CAST(b AS VARCHAR) AS bucket FROM truth t JOIN (SELECT market_id, wallet, count_if(hit)>0 AND count_if(is_alert)=0 AS w, CAST(CAST(substr(wallet,3) AS BIGINT) % 5 AS INTEGER) AS b FROM boosted GROUP BY 1,2) x USING (market_id, wallet))
GROUP BY CUBE (decisive, bucket)""")
def _(spark, sf):
    c = counterfactual(spark, sf, frozen(spark, sf))
    bucket = F.regexp_replace("wallet", "^0x0*(?=[0-9])", "").cast("long") % 5
    rows = truth(spark, sf).join(c, ["market_id", "wallet"]).withColumn("bucket", bucket.cast("string")).withColumn("decisive", F.col("decisive").cast("string"))
    return rounded(rounded(sweeps.cohort_economics(rows, ["decisive", "bucket"]), 2, ("mean_return",)), 5)


@query("trade_counterfactual", """
SELECT cohort, count(*) AS trades, round(sum(pnl),2) AS pnl, round(avg(trade_return),5) AS mean_return, round(count_if(is_win)/count(*),5) AS win_rate FROM (
 SELECT b.*, unnest(list_filter([CASE WHEN s.hit AND NOT s.is_alert THEN 'boosted_into_alert' END, CASE WHEN s.hit AND s.is_alert AND s.multiplier>1 THEN 'boosted_anyway' END,
  CASE WHEN s.multiplier>1 THEN 'any_boost' END, CASE WHEN NOT s.hit THEN 'not_flagged' END], lambda x: x IS NOT NULL)) AS cohort FROM buys b JOIN (SELECT seq, hit, is_alert, multiplier FROM boosted) s USING (seq)) GROUP BY 1""")
def _(spark, sf):
    s = frozen(spark, sf).withColumn("multiplier", _mult())
    hit = scoring.boosted(F.col("base_score"), F.col("multiplier"), CFG["score_cap"]) >= CFG["alert_threshold"]
    marks = s.select("seq", "multiplier", F.col("is_alert").alias("base_hit"), hit.alias("boosted_hit"))
    buys = labels.buy_returns(tape(spark, sf), winners(spark, sf)).join(marks, "seq")
    return rounded(rounded(sweeps.trade_counterfactual(buys), 2, ("mean_return", "win_rate")), 5)


@query("boosted_wallet_eval", "SELECT t.market_id, t.wallet, round(net_pnl,2) AS net_pnl, is_insider FROM truth t WHERE (market_id, wallet) IN (SELECT market_id, wallet FROM boosted WHERE hit AND NOT is_alert AND side='BUY')")
def _(spark, sf):
    s = frozen(spark, sf).withColumn("multiplier", _mult())
    hit = scoring.boosted(F.col("base_score"), F.col("multiplier"), CFG["score_cap"]) >= CFG["alert_threshold"]
    who = s.where(hit & ~F.col("is_alert") & (F.col("side") == "BUY")).select("market_id", "wallet").distinct()
    return truth(spark, sf).join(who, ["market_id", "wallet"], "left_semi").select("market_id", "wallet", *rnd("net_pnl", digits=2), "is_insider")


@query("cluster_returns", "SELECT market_id, community, count(*) AS wallets, round(sum(gross_buy),2) AS gross_buy, round(sum(net_pnl),2) AS net_pnl, round(avg(wallet_return),5) AS mean_return, round(coalesce(sum(wallet_return*gross_buy)/nullif(sum(gross_buy),0),0),5) AS weighted_return, arg_max(wallet,(net_pnl,wallet)) AS peak_wallet, round(count_if(is_insider)/count(*),5) AS insider_precision, round(median(wallet_return),5) AS median_return FROM truth t JOIN (SELECT market_id, node AS wallet, community FROM member) m USING (market_id, wallet) GROUP BY 1,2")
def _(spark, sf):
    df = sweeps.cluster_returns(truth(spark, sf), member(spark, sf))
    return rounded(rounded(df, 2, [c for c in df.columns if c not in ("gross_buy", "net_pnl")]), 5)


def classes(spark, sf):
    return tables.markets(spark, sf).select("market_id", "category", (F.col("market_id") % 3 != 0).alias("insider_plausible"))


@query("category_eval", f"""SELECT slice, num_wallets, num_predicted, num_insiders, tp, fp, fn, tn, {r('precision recall f1 f0_5 f2', 5)} FROM (SELECT *, {FSCORES_SQL} FROM (
 SELECT slice, count(*) AS num_wallets, count_if(predicted) AS num_predicted, count_if(is_insider) AS num_insiders, count_if(predicted AND is_insider) AS tp, count_if(predicted AND NOT is_insider) AS fp,
  count_if(NOT predicted AND is_insider) AS fn, count_if(NOT predicted AND NOT is_insider) AS tn FROM (SELECT e.*, unnest(CASE WHEN m.market_id % 3<>0 THEN ['all','plausible',category] ELSE ['all',category] END) AS slice FROM evals e JOIN markets m ON m.market_id=e.market_id) GROUP BY 1))""")
def _(spark, sf):
    return rounded(sweeps.slice_metrics(predicted(spark, sf), classes(spark, sf)), 5)


@query("slice_ranking", "SELECT category, num_flagged FROM (SELECT category, count_if(predicted) AS num_flagged FROM evals e JOIN markets m ON m.market_id=e.market_id GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, sf):
    rows = predicted(spark, sf).join(classes(spark, sf).select("market_id", "category"), "market_id")
    return rows.groupBy("category").agg(F.count_if("predicted").alias("num_flagged")).orderBy(F.desc("num_flagged"), "category").limit(3)


DOMAINS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("domain_matrix", """WITH g AS (SELECT category, threshold, count_if(p AND is_insider) AS tp, count_if(p AND NOT is_insider) AS fp, count_if(NOT p AND is_insider) AS fn FROM
 (SELECT category, threshold, flag_rate>=threshold AS p, is_insider FROM evals e JOIN markets m ON m.market_id=e.market_id, (SELECT CAST(i AS DOUBLE)/10 AS threshold FROM range(1,11) t(i))) GROUP BY 1,2),
s AS (SELECT category, threshold, coalesce(2*tp/nullif(2*tp+fn+fp,0),0) AS f1 FROM g), b AS (SELECT category AS train, arg_max(threshold,(f1,-threshold)) AS threshold FROM s GROUP BY 1)
SELECT train, """ + ", ".join(f"round(max(CASE WHEN s.category='{d}' THEN f1 END),5) AS \"{d}\"" for d in DOMAINS) + " FROM b JOIN s USING (threshold) GROUP BY 1")
def _(spark, sf):
    thr = spark.range(1, 11).select((F.col("id") / 10.0).alias("threshold"))
    m = sweeps.domain_matrix(evaluations(spark, sf), classes(spark, sf), thr)
    return m.groupBy("train").pivot("test", DOMAINS).agg(F.round(F.max("f1"), 5))


view("reported", "SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS market_id, '0x'||lpad(CAST(c_custkey AS VARCHAR),40,'0') AS wallet FROM customer")


def reported(spark, sf):
    return tables.read(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("market_id"), tables.wallet_of(F.col("c_custkey")).alias("wallet")).distinct()


RECALL_SQL = """SELECT r.market_id, r.wallet, s.trade_count IS NOT NULL AS present, coalesce(num_flags,0) AS num_flags, coalesce(num_flags/s.trade_count,0) AS flag_rate,
 coalesce(num_flags>0,false) AS any_flag, coalesce(num_flags/s.trade_count>=0.5,false) AS classified FROM reported r LEFT JOIN suspicion s USING (market_id, wallet)"""


@query("reported_recall", f"SELECT market_id, count(*) AS reported, count(DISTINCT wallet) AS unique_wallets, count_if(present) AS present, count_if(any_flag) AS any_flag, count_if(classified) AS classified, round(coalesce(count_if(any_flag)/nullif(count_if(present),0),0),5) AS any_flag_recall, round(coalesce(count_if(classified)/nullif(count_if(present),0),0),5) AS classified_recall FROM ({RECALL_SQL}) GROUP BY 1")
def _(spark, sf):
    rec = sweeps.reported_recall(reported(spark, sf), scoring.wallet_suspicion(frozen(spark, sf)))
    return rounded(sweeps.recall_summary(rec, ["market_id"]), 5)


@query("curated_comparison", f"SELECT count(*) AS reported, count(DISTINCT wallet) AS unique_wallets, count_if(present) AS present, count_if(any_flag) AS any_flag, count_if(classified) AS classified, round(coalesce(count_if(any_flag)/nullif(count_if(present),0),0),5) AS any_flag_recall, round(coalesce(count_if(classified)/nullif(count_if(present),0),0),5) AS classified_recall FROM ({RECALL_SQL}) WHERE market_id NOT IN (SELECT market_id FROM markets WHERE category='ASIA')")
def _(spark, sf):
    train = tables.markets(spark, sf).where("category = 'ASIA'").select("market_id")  # leakage guard
    rec = sweeps.reported_recall(reported(spark, sf), scoring.wallet_suspicion(frozen(spark, sf))).join(train, "market_id", "left_anti")
    return rounded(sweeps.recall_summary(rec), 5)


@query("zscore_recall", "SELECT 'full' AS method, count_if(a AND is_insider) AS any_tp, count_if(a AND NOT is_insider) AS any_fp, count_if(NOT a AND is_insider) AS any_fn, count_if(predicted AND is_insider) AS classified_tp, count_if(predicted AND NOT is_insider) AS classified_fp, count_if(NOT predicted AND is_insider) AS classified_fn, CAST(sum(num_flags) AS BIGINT) AS flag_volume FROM (SELECT *, num_flags>0 AS a FROM evals)")
def _(spark, sf):
    s = scoring.wallet_suspicion(frozen(spark, sf))
    states = s.select(F.lit("full").alias("method"), "market_id", "wallet", "num_flags", (F.col("num_flags") > 0).alias("any_flag"),
                      (F.col("num_flags") / F.col("trade_count") >= FLAG_RATE).alias("classified"))
    return sweeps.label_recall(states, truth(spark, sf))


def grid(spark):
    return sweeps.param_grid(spark, {**{f"w_{d}": [0.0, 1.0] for d in DETS}, "alert_threshold": [0.3, 0.5], "flag_rate": [0.25, 0.5]})


GRID_SQL = "SELECT row_number() OVER (ORDER BY " + ",".join(f"w_{d}" for d in DETS) + ",alert_threshold,flag_rate)-1 AS candidate, * FROM " + ", ".join(
    f"(SELECT unnest([0.0,1.0]) AS w_{d}) g{i}" for i, d in enumerate(DETS)) + ", (SELECT unnest([0.3,0.5]) AS alert_threshold) ga, (SELECT unnest([0.25,0.5]) AS flag_rate) gf"


@query("evaluate_candidates", f"""
WITH g AS ({GRID_SQL}), h AS (SELECT candidate, market_id, wallet, count(*) AS nf FROM scored, g WHERE 1-{'*'.join(f'(1-conf_{d}*w_{d})' for d in DETS)}>=alert_threshold GROUP BY 1,2,3),
p AS (SELECT h.candidate, nf/trade_count>=flag_rate AS predicted, is_insider FROM h JOIN truth USING (market_id, wallet) JOIN g ON g.candidate=h.candidate),
c AS (SELECT candidate, count_if(predicted AND is_insider) AS tp, count_if(predicted AND NOT is_insider) AS fp FROM p GROUP BY 1),
n AS (SELECT count(*) AS num_wallets, count_if(is_insider) AS num_insiders FROM truth)
SELECT candidate, tp, fp, fn, num_wallets, num_insiders, {r('precision recall f1 f0_5 f2', 5)} FROM (SELECT *, {FSCORES_SQL} FROM (SELECT g.candidate, coalesce(tp,0) AS tp, coalesce(fp,0) AS fp, num_insiders-coalesce(tp,0) AS fn, num_wallets, num_insiders FROM g LEFT JOIN c USING (candidate), n))""")
def _(spark, sf):
    return rounded(sweeps.evaluate_candidates(frozen(spark, sf), truth(spark, sf), grid(spark), DETS), 5)


@query("coordinate_descent")
def _(spark, sf):
    s, t = frozen(spark, sf), cut(truth(spark, sf))
    start = {**{f"w_{d}": 1.0 for d in DETS}, "alert_threshold": 0.5, "flag_rate": 0.5}
    groups = [{"alert_threshold": [0.3, 0.5, 0.7], "flag_rate": [0.25, 0.5, 0.75]}, {f"w_{d}": [0.5, 1.0] for d in DETS}]
    best, log = sweeps.coordinate_descent(lambda g: sweeps.evaluate_candidates(s, t, g, DETS), spark, start, groups, passes=1)
    return spark.createDataFrame([(k, float(v), float(log[-1][2])) for k, v in best.items()], "parameter string, value double, objective double")


# ---- candidates of the detectors' own settings
TRIED = {
    "extreme_position": {"tail_threshold": [0.12, 0.2, 0.33], "min_notional": [400.0, 1500.0, 3000.0], "max_confidence": [0.4, 0.6, 0.95]},
    "probability_impact": {"min_delta_prob": [0.055, 0.3], "min_delta_log_odds": [0.9, 1.5], "min_notional": [250.0, 1500.0], "max_confidence": [0.25, 0.55, 0.8]},
    "accumulation": {"min_accumulation_usdc": [500.0, 3500.0], "min_directional_ratio": [0.83, 0.95], "max_confidence": [0.18, 0.6], "min_outcome_concentration": [0.78, 0.91]},
    "alert_threshold": {"value": [0.3, 0.45, 0.5, 0.6]},
}
SEARCH_RATE = 0.25
_flip = "(w_volume>=10000 AND directional_ratio<0.5)"
_dp = "abs(price-prev_price)"
_lo = "abs(CASE WHEN price>0.001 AND price<0.999 THEN ln(price/(1-price)) END-CASE WHEN prev_price>0.001 AND prev_price<0.999 THEN ln(prev_price/(1-prev_price)) END)"
_CONF = {
    "extreme_position": f"""CASE WHEN notional_usdc>=min_notional AND NOT {_flip} AND ((price<tail_threshold AND side='BUY') OR (price>1-tail_threshold AND side='SELL'))
 THEN (0.5*least(1.0,(CASE WHEN side='BUY' THEN tail_threshold-price ELSE price-(1-tail_threshold) END)/tail_threshold)+0.5*least(1.0,notional_usdc/5000))*max_confidence ELSE 0 END""",
    "probability_impact": f"""CASE WHEN notional_usdc>=min_notional AND {_dp}>=1e-6 THEN coalesce(CASE WHEN {_dp}>=min_delta_prob AND {_lo}>=min_delta_log_odds
 THEN 0.4*least(1.0,{_dp}/(2*min_delta_prob))+0.6*least(1.0,{_lo}/(2*min_delta_log_odds)) WHEN {_dp}>=min_delta_prob THEN least(1.0,{_dp}/(2*min_delta_prob))
 WHEN {_lo}>=min_delta_log_odds THEN least(1.0,{_lo}/(2*min_delta_log_odds)) END,0)*max_confidence ELSE 0 END""",
    "accumulation": """CASE WHEN side='BUY' AND w_trades>0 AND outcome_concentration>=min_outcome_concentration AND outcome_directional>=min_directional_ratio AND outcome_exposure>=min_accumulation_usdc
 THEN outcome_directional*max_confidence ELSE 0 END""",
}


def _alerts_sql(group):
    names = list(TRIED[group])
    grid = ", ".join(f"(SELECT CAST(unnest({v}) AS DOUBLE) AS {k}) g{i}" for i, (k, v) in enumerate(TRIED[group].items()))
    fires = f"{_score()}>=value" if group == "alert_threshold" else f"1-{'*'.join(f'(1-conf_{d})' for d in DETS if d != group)}*(1-({_CONF[group]}))>=0.5"
    return f"""SELECT '{group}' AS grp, candidate, market_id, wallet, count(*) AS nf FROM scored, (SELECT row_number() OVER (ORDER BY {','.join(names)})-1 AS candidate, * FROM {grid}) WHERE {fires} GROUP BY 2,3,4"""


@query("setting_candidates", f"""
WITH h AS ({' UNION ALL '.join(_alerts_sql(g) for g in TRIED)}),
every AS ({' UNION ALL '.join(f"SELECT '{g}' AS grp, unnest(range({len(list(itertools.product(*v.values())))})) AS candidate" for g, v in TRIED.items())}),
c AS (SELECT grp, candidate, count_if(is_insider) AS tp, count_if(NOT is_insider) AS fp FROM h JOIN truth USING (market_id, wallet) WHERE nf/trade_count>={SEARCH_RATE} GROUP BY 1,2),
n AS (SELECT count(*) AS num_wallets, count_if(is_insider) AS num_insiders FROM truth)
SELECT grp, candidate, tp, fp, fn, num_wallets, num_insiders, {r('precision recall f1 f0_5 f2', 5)} FROM (SELECT *, {FSCORES_SQL} FROM (
 SELECT e.grp, e.candidate, coalesce(tp,0) AS tp, coalesce(fp,0) AS fp, num_insiders-coalesce(tp,0) AS fn, num_wallets, num_insiders FROM every e LEFT JOIN c USING (grp, candidate), n))""")
def _(spark, sf):
    s, t = search.states(tape(spark, sf), CFG), truth(spark, sf)
    parts = [search.evaluated(s, t, g, v, CFG, SEARCH_RATE) for g, v in TRIED.items()]
    cols = ["candidate", "tp", "fp", "fn", "num_wallets", "num_insiders", "precision", "recall", "f1", "f0_5", "f2"]
    return rounded(union_all([p.select(F.lit(g).alias("grp"), *cols) for g, p in zip(TRIED, parts)]), 5)


@query("setting_search")
def _(spark, sf):
    """Settings found by descent over the groups until none improves, with the score after each step."""
    t = tape(spark, sf)
    _cfg, _best, log = search.descend(t, search.states(t, CFG), truth(spark, sf), CFG, TRIED, SEARCH_RATE)
    return spark.createDataFrame([(int(p), g, round(float(s), 6)) for p, g, s in log], "pass int, grp string, score double")


@query("multi_start_summary", f"""
WITH g AS ({GRID_SQL}), h AS (SELECT candidate, market_id, wallet, count(*) AS nf FROM scored, g WHERE 1-{'*'.join(f'(1-conf_{d}*w_{d})' for d in DETS)}>=alert_threshold GROUP BY 1,2,3),
p AS (SELECT h.candidate, t.market_id % 2 AS part, nf/trade_count>=flag_rate AS predicted, is_insider FROM h JOIN truth t USING (market_id, wallet) JOIN g ON g.candidate=h.candidate),
n AS (SELECT market_id % 2 AS part, count_if(is_insider) AS ni FROM truth GROUP BY 1),
q AS (SELECT g.candidate, n.part, coalesce(2*count_if(predicted AND is_insider)/nullif(count_if(predicted)+any_value(ni),0),0) AS f1 FROM g CROSS JOIN n LEFT JOIN p ON p.candidate=g.candidate AND p.part=n.part GROUP BY 1,2),
s AS (SELECT candidate, max(CASE WHEN part=0 THEN f1 END) AS train_score, max(CASE WHEN part=1 THEN f1 END) AS val_score FROM q GROUP BY 1)
SELECT arg_max(candidate,(round(train_score,9),-candidate)) AS best_start, round(min(train_score),5) AS min_score, round(median(train_score),5) AS median_score, round(max(train_score),5) AS max_score, round(max(train_score)-min(train_score),5) AS spread, round(avg(train_score-val_score),5) AS mean_gap FROM s""")
def _(spark, sf):
    s, t = frozen(spark, sf), truth(spark, sf)
    a = sweeps.evaluate_candidates(s, t.where("market_id % 2 = 0"), grid(spark), DETS).select(F.col("candidate").alias("start_id"), F.round("f1", 9).alias("train_score"))
    b = sweeps.evaluate_candidates(s, t.where("market_id % 2 = 1"), grid(spark), DETS).select(F.col("candidate").alias("start_id"), F.round("f1", 9).alias("val_score"))
    return rounded(sweeps.multi_start_summary(a.join(b, "start_id")), 5)


@query("coarse_markets", "WITH c AS (SELECT market_id, count(*) AS n_trades FROM tape GROUP BY 1) SELECT * FROM c WHERE n_trades<=10 UNION ALL (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c WHERE n_trades<=10) ORDER BY n_trades, market_id LIMIT 1)")
def _(spark, sf):
    return sweeps.coarse_markets(markets.trade_counts(tape(spark, sf)), 10)


# ---- composed jobs ----------------------------------------------------------
@query("evaluate")
def _(spark, sf):
    t = tape(spark, sf)
    boosts = causal.boost_schedule(t, CFG, tables.transfers(spark, sf)).select("market_id", "seq", "multiplier")
    base = frozen(spark, sf).join(boosts, ["market_id", "seq"])
    s = scoring.recidivism_replay(base, CFG)
    s = cut(s.drop("prior_flags_capped"))
    return rounded(economics.quality_composite(economics.econ_fbeta(all_metrics(spark, sf, s))), 5)


@query("train_test_window")
def _(spark, sf):
    """Settings learned on the trades before a date, tested on the later ones."""
    t, win = tape(spark, sf), winners(spark, sf)
    split = 1704067200000 + 15 * DAY_MS
    wallets = cut(labels.ground_truth(t, win, CFG))
    every = search.states(t, CFG)
    cfg, _best, _log = search.descend(t, every.where(F.col("timestamp_ms") < split), wallets, CFG, TRIED, SEARCH_RATE)
    later = search.states(t, cfg).where(F.col("timestamp_ms") >= split)
    return rounded(search.evaluated(later, wallets, "alert_threshold", {"value": [cfg["alert_threshold"]]}, cfg, SEARCH_RATE).drop("p_value"), 5)


@query("legacy_boost", """
SELECT market_id, wallet, round(b*j,6) AS boost, round(b*j*suspicion,5) AS boosted_suspicion FROM (
 SELECT s.market_id, s.wallet, s.suspicion, CASE WHEN jump_boost>1.001 THEN jump_boost ELSE 1 END AS j,
  CASE WHEN c.community IS NULL THEN 1 ELSE least(1+least(size/50.0,0.3)+density*0.2+CASE WHEN coalesce(has_common_ownership,false) THEN 0.4 ELSE 0 END,2.0) END AS b
 FROM suspicion s JOIN jscores USING (market_id, wallet) LEFT JOIN member m ON m.market_id=s.market_id AND m.node=s.wallet
 LEFT JOIN cmeta c ON c.market_id=m.market_id AND c.community=m.community LEFT JOIN owned o ON o.market_id=m.market_id AND o.community=m.community)""")
def _(spark, sf):
    """Cluster boosts on a given partition, so that SQL can follow; ``boosts_for_markets`` finds the clusters itself."""
    from tapescope.operators import graph, jumps
    from tapescope.plans.graphs import member, meta_with_boost
    t = tape(spark, sf)
    given = graph.wallet_boosts(member(spark, sf), meta_with_boost(spark, sf)).select("market_id", "wallet", "boost", "has_common_ownership")
    rows = graph.apply_wallet_boosts(scoring.wallet_suspicion(frozen(spark, sf)), given)
    out = jumps.apply_jump_boost(rows, jumps.score_jump_wallets(t, jumps.find_jumps(t, CFG), CFG))
    return out.select("market_id", "wallet", *rnd("boost"), F.round(F.col("boost") * F.col("suspicion"), 5).alias("boosted_suspicion"))


@query("trade_metrics_for_flags", "SELECT market_id, count_if(is_flagged) AS trade_flagged_count, count_if(NOT is_flagged) AS trade_unflagged_count, round(coalesce(avg(trade_return) FILTER (is_flagged),0),5) AS trade_flagged_mean_return, round(coalesce(avg(trade_return) FILTER (NOT is_flagged),0),5) AS trade_unflagged_mean_return FROM fbuys GROUP BY 1")
def _(spark, sf):
    m = economics.trade_metrics(flagged_buys(spark, sf), ["market_id"])
    return rounded(m.select("market_id", "trade_flagged_count", "trade_unflagged_count", "trade_flagged_mean_return", "trade_unflagged_mean_return"), 5)


@query("persisted_state_reload", "SELECT count(*) AS n_edges, round(sum(weight),4) AS weight FROM edges")
def _(spark, sf):
    from tapescope.operators import graph
    log = cut(tape(spark, sf).select("market_id", "wallet", "timestamp_ms", "side", "outcome_index", "notional_usdc"))
    return graph.totals(graph.bucket_graph(log, CFG, packed=True), []).select("n_edges", F.round("total_edge_weight", 4).alias("weight"))
