"""Did the flagged trades pay?  Event study, copy-trading, pooled metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.functions import stats
from tapescope.functions.stats import div
from tapescope.operators.labels import buy_returns
from tapescope.operators.quantiles import exact_quantiles, medians
from tapescope.operators.running import Track
from tapescope.operators.scan import ranged
from tapescope.operators.scoring import conf_columns, fired

FLAG_KEY = ["market_id", "wallet", "timestamp_ms"]


def flag_keys(scored: DataFrame) -> DataFrame:
    """One row per flagged (market, wallet, ms) with the last alert's score and detectors."""
    detectors = fired(scored) if conf_columns(scored) else F.array().cast("array<string>")
    return (scored.where("is_alert").groupBy(*FLAG_KEY)
            .agg(F.max_by(F.struct(F.col("total_score").alias("score"), detectors.alias("detectors")), F.col("seq")).alias("_f"))
            .select(*FLAG_KEY, F.col("_f.score").alias("flag_score"), F.col("_f.detectors").alias("flag_detectors")))


def flagged_buys(tape: DataFrame, winners: DataFrame, flags: DataFrame) -> DataFrame:
    """BUY trades of resolved markets, marked when their (wallet, ms) is flagged."""
    buys = buy_returns(tape, winners)
    return buys.join(flags, FLAG_KEY, "left").withColumn("is_flagged", F.col("flag_score").isNotNull())


def semi_flagged(tape: DataFrame, flags: DataFrame, keep: bool = True) -> DataFrame:
    """Trades whose (market, wallet, ms) is (or is not) flagged."""
    return tape.join(flags.select(*FLAG_KEY), FLAG_KEY, "left_semi" if keep else "left_anti")


def _side_aggs(flag: Column, p: str, value: str = "trade_return") -> list[Column]:
    x, w = F.when(flag, F.col(value)), F.when(flag, F.col("notional_usdc"))
    return [F.count_if(flag).alias(f"{p}_n"), F.sum(w).alias(f"{p}_w"), F.avg(x).alias(f"{p}_mean"),
            F.var_samp(x).alias(f"{p}_var"), F.sum(w * w).alias(f"{p}_ww"), F.sum(w * x).alias(f"{p}_wx"),
            F.sum(w * x * x).alias(f"{p}_wxx"), F.count_if(flag & F.col("is_win")).alias(f"{p}_wins"),
            F.count_if(flag & (F.col(value) > 0)).alias(f"{p}_pos")]


def two_sided(buys: DataFrame, by: list[str], value: str = "trade_return") -> DataFrame:
    """Sums of both flag groups in one pass: n, w, mean, var, ww, wx, wxx, wins, pos."""
    return buys.groupBy(*by).agg(*_side_aggs(F.col("is_flagged"), "f", value),
                                 *_side_aggs(~F.col("is_flagged"), "u", value))


def _weighted_mean(p: str) -> Column:
    return F.coalesce(F.when(F.col(f"{p}_w") >= 1e-12, F.col(f"{p}_wx") / F.col(f"{p}_w")), F.col(f"{p}_mean"), F.lit(0.0))


def _weighted_var(p: str) -> Column:
    m = F.col(f"{p}_wx") / F.col(f"{p}_w")
    var = F.col(f"{p}_wxx") / F.col(f"{p}_w") - m * m
    return F.coalesce(F.when((F.col(f"{p}_w") >= 1e-12) & (F.col(f"{p}_n") >= 2), F.greatest(var, F.lit(0.0))), F.lit(0.0))


def _sides(*names: str) -> list[Column]:
    return [F.col(f"{p}_{n}") for p in ("f", "u") for n in names]


def event_study(buys: DataFrame, by: list[str] = ["market_id", "winner"]) -> DataFrame:
    """Per market: returns of flagged against unflagged BUY trades, with both tests.

    Markets need at least one trade on either side.  The Mann-Whitney p-value is
    the normal approximation with tie and continuity correction.
    """
    agg = two_sided(buys, by).where("f_n >= 1 and u_n >= 1")
    med = medians(buys, by, {
        "flagged_median_return": F.when(F.col("is_flagged"), F.col("trade_return")),
        "unflagged_median_return": F.when(~F.col("is_flagged"), F.col("trade_return"))})
    d = stats.pooled_d(*_sides("n", "mean", "var"))
    t, df = stats.welch(*_sides("n", "mean", "var"))
    out = agg.join(med, by).join(rank_sums(buys, by), by)
    out = out.select(
        *by, (F.col("f_n") + F.col("u_n")).alias("total_buy_trades"), F.col("f_n").alias("flagged_buy_trades"),
        F.col("u_n").alias("unflagged_buy_trades"), F.col("f_w").alias("flagged_total_notional"),
        F.col("u_w").alias("unflagged_total_notional"), F.col("f_mean").alias("flagged_mean_return"),
        "flagged_median_return", F.coalesce(F.sqrt("f_var"), F.lit(0.0)).alias("flagged_std_return"),
        F.col("u_mean").alias("unflagged_mean_return"), "unflagged_median_return",
        F.coalesce(F.sqrt("u_var"), F.lit(0.0)).alias("unflagged_std_return"),
        (F.col("f_mean") - F.col("u_mean")).alias("mean_return_diff"), d.alias("cohens_d"),
        t.alias("welch_t"), df.alias("welch_df"), "mann_whitney_u", "mann_whitney_z",
        div(F.col("f_wx"), F.col("f_w")).alias("flagged_weighted_return"),
        div(F.col("u_wx"), F.col("u_w")).alias("unflagged_weighted_return"),
        (F.col("f_wins") / F.col("f_n")).alias("flagged_win_rate"),
        (F.col("u_wins") / F.col("u_n")).alias("unflagged_win_rate"))
    return out


def with_p_values(study: DataFrame) -> DataFrame:
    """Add welch_p and mann_whitney_p (one small kernel call per market row)."""
    return study.withColumns({"welch_p": stats.p_student(F.col("welch_t"), F.col("welch_df")),
                              "mann_whitney_p": stats.p_normal(F.col("mann_whitney_z"))})


def rank_sums(buys: DataFrame, by: list[str]) -> DataFrame:
    """Mann-Whitney U of the flagged group and its normal score, by group.

    Works on the histogram of distinct returns: the flagged trades at a value
    beat all unflagged ones below it and tie with half of those at it.
    """
    hist = buys.groupBy(*by, "trade_return").agg(
        F.count_if("is_flagged").alias("_f"), F.count_if(~F.col("is_flagged")).alias("_u"))
    below = ranged(hist, by, ["trade_return"], [Track("_ub", "sum", F.col("_u"))])
    t = (F.col("_f") + F.col("_u")).cast("double")
    agg = below.groupBy(*by).agg(
        F.sum(F.col("_f") * (F.col("_ub") + F.col("_u") / 2.0)).alias("mann_whitney_u"),
        F.sum(t * t * t - t).alias("_ties"), F.sum("_f").cast("double").alias("_nf"),
        F.sum("_u").cast("double").alias("_nu"))
    n, nf, nu = F.col("_nf") + F.col("_nu"), F.col("_nf"), F.col("_nu")
    s = F.sqrt(nf * nu / 12.0 * ((n + 1.0) - F.col("_ties") / (n * (n - 1.0))))
    z = F.when(s > 0, (F.col("mann_whitney_u") - nf * nu / 2.0 - 0.5) / s)
    return agg.select(*by, "mann_whitney_u", z.alias("mann_whitney_z"))


# lower edges of the score bands, the last one closed: fixed values
BANDS = [(0.5, "0.5-0.6"), (0.6, "0.6-0.7"), (0.7, "0.7-0.8"), (0.8, "0.8-0.9"), (0.9, "0.9-1.0")]


def _slices(buys: DataFrame, by: list[str]) -> DataFrame:
    agg = buys.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg("trade_return").alias("mean_return"),
        div(F.sum(F.col("trade_return") * F.col("notional_usdc")), F.sum("notional_usdc")).alias("weighted_return"),
        (F.count_if(F.col("trade_return") > -0.999) / F.count(F.lit(1))).alias("win_rate"))
    return agg.join(medians(buys, by, {"median_return": F.col("trade_return")}), by)


def event_study_by_band(buys: DataFrame) -> DataFrame:
    s = F.col("flag_score")
    band = F.when(s > 1.01, None)
    for i, (lo, name) in enumerate(BANDS):
        hi = BANDS[i + 1][0] if i + 1 < len(BANDS) else 1.01
        band = band.when((s >= lo) & (s < hi), name)
    return _slices(buys.where("is_flagged").withColumn("band", band).where("band is not null"), ["market_id", "band"])


def event_study_by_detector(buys: DataFrame) -> DataFrame:
    rows = buys.where("is_flagged").withColumn("detector", F.explode("flag_detectors"))
    return _slices(rows, ["market_id", "detector"])


def event_study_pooled(study: DataFrame) -> DataFrame:
    """One row over the per-market studies, weighted by count and by notional."""
    has_p = "welch_p" in study.columns
    n_f, n_u = F.col("flagged_buy_trades"), F.col("unflagged_buy_trades")
    w_f, w_u = F.col("flagged_total_notional"), F.col("unflagged_total_notional")
    agg = study.agg(
        F.count(F.lit(1)).alias("n_markets"), F.sum(n_f).alias("total_flagged_trades"),
        F.sum(n_u).alias("total_unflagged_trades"), F.sum(w_f).alias("total_flagged_notional"),
        F.sum(w_u).alias("total_unflagged_notional"),
        div(F.sum(F.col("flagged_mean_return") * n_f), F.sum(n_f)).alias("pooled_flagged_mean_return"),
        div(F.sum(F.col("unflagged_mean_return") * n_u), F.sum(n_u)).alias("pooled_unflagged_mean_return"),
        div(F.sum(F.col("flagged_weighted_return") * w_f), F.sum(w_f)).alias("pooled_flagged_weighted_return"),
        div(F.sum(F.col("unflagged_weighted_return") * w_u), F.sum(w_u)).alias("pooled_unflagged_weighted_return"),
        F.avg("cohens_d").alias("mean_cohens_d"),
        *([F.count_if(F.col("welch_p") < 0.05).alias("markets_significant_welch"),
           F.count_if(F.col("mann_whitney_p") < 0.05).alias("markets_significant_mw")] if has_p else []))
    return agg.withColumn("pooled_mean_return_diff",
                          F.col("pooled_flagged_mean_return") - F.col("pooled_unflagged_mean_return"))


def copytrade(buys: DataFrame, fixed_size: float | None = None, by: list[str] = ["market_id"]) -> DataFrame:
    """Copy every flagged BUY: notional-matched and (optionally) fixed-size portfolios."""
    rows = buys.where("is_flagged")
    n = F.count(F.lit(1))
    agg = rows.groupBy(*by).agg(
        n.alias("flagged_buys"), F.sum("notional_usdc").alias("capital"), F.sum("payout").alias("payout"),
        F.count_if("is_win").alias("winning_trades"), F.avg("pnl_return").alias("mean_trade_return"),
        F.coalesce(F.stddev_samp("pnl_return"), F.lit(0.0)).alias("std_trade_return"),
        div(F.sum(F.col("pnl_return") * F.col("notional_usdc")), F.sum("notional_usdc")).alias("weighted_return"))
    out = agg.join(medians(rows, by, {"median_trade_return": F.col("pnl_return")}), by)
    out = out.withColumns({
        "pnl": F.col("payout") - F.col("capital"),
        "roi": F.when(F.col("capital") > 1e-9, (F.col("payout") - F.col("capital")) / F.col("capital")).otherwise(0.0),
        "losing_trades": F.col("flagged_buys") - F.col("winning_trades"),
        "win_rate": F.col("winning_trades") / F.col("flagged_buys")})
    if fixed_size:
        cap = F.col("flagged_buys") * F.lit(float(fixed_size))
        out = out.withColumns({"fixed_capital": cap, "fixed_roi": F.col("mean_trade_return"),
                               "fixed_pnl": F.col("mean_trade_return") * cap,
                               "fixed_median_return": F.col("median_trade_return")})
    return out


def copytrade_pooled(per_market: DataFrame) -> DataFrame:
    """The portfolio over all markets; its median is the median of market medians."""
    n = F.col("flagged_buys")
    agg = per_market.agg(
        F.sum(n).alias("flagged_buys"), F.sum("capital").alias("capital"), F.sum("payout").alias("payout"),
        F.sum("winning_trades").alias("winning_trades"),
        div(F.sum(F.col("mean_trade_return") * n), F.sum(n)).alias("mean_trade_return"),
        F.percentile("median_trade_return", F.lit(0.5)).alias("median_trade_return"))
    pnl = F.col("payout") - F.col("capital")
    return agg.withColumns({
        "pnl": pnl, "roi": F.when(F.col("capital") > 1e-9, pnl / F.col("capital")).otherwise(0.0),
        "losing_trades": F.col("flagged_buys") - F.col("winning_trades"),
        "win_rate": div(F.col("winning_trades"), F.col("flagged_buys"))})


Z = 1.64  # one-sided 95% normal quantile used for the lower bounds: fixed value


def trade_metrics(buys: DataFrame, by: list[str] = [], value: str = "trade_return", prefix: str = "trade") -> DataFrame:
    """Pooled means, differences, effect sizes and lower bounds of the flag groups."""
    a = two_sided(buys, by, value)
    n_f, n_u, m_f, m_u = F.col("f_n"), F.col("u_n"), F.coalesce("f_mean", F.lit(0.0)), F.coalesce("u_mean", F.lit(0.0))
    both = (n_f > 0) & (n_u > 0)
    vf, vu = F.col("f_var"), F.col("u_var")
    se = F.when(vf + vu > 1e-15, F.sqrt(vf / n_f + vu / n_u)).otherwise(0.0)
    t = F.coalesce(F.when((n_f >= 2) & (n_u >= 2) & (se > 1e-12), (m_f - m_u) / se), F.lit(0.0))
    d = stats.pooled_d(n_f, m_f, vf, n_u, m_u, vu)
    d_se = F.when((n_f >= 2) & (n_u >= 2), stats.d_standard_error(d, n_f.cast("double"), n_u.cast("double"))).otherwise(0.0)
    mean_se = F.coalesce(F.sqrt(vf / n_f), F.lit(0.0))
    wf, wu = _weighted_mean("f"), _weighted_mean("u")
    eff_f = div(F.col("f_w") * F.col("f_w"), F.col("f_ww"))
    eff_u = div(F.col("u_w") * F.col("u_w"), F.col("u_ww"))
    wd = stats.pooled_d(n_f, wf, _weighted_var("f"), n_u, wu, _weighted_var("u"))
    wd_se = stats.d_standard_error(wd, eff_f, eff_u)
    w_se = F.when(eff_f > 1.0, F.sqrt(_weighted_var("f") / eff_f)).otherwise(0.0)

    def if_both(c: Column) -> Column:
        return F.when(both, c).otherwise(0.0)

    cols = {
        "flagged_count": n_f, "unflagged_count": n_u, "flagged_mean_return": m_f, "unflagged_mean_return": m_u,
        "flagged_mean_return_se": mean_se, "flagged_mean_return_lcb": m_f - Z * mean_se,
        "mean_return_diff": m_f - m_u, "t_stat": t, "cohens_d": d, "cohens_d_se": d_se, "cohens_d_lcb": d - Z * d_se,
        "flagged_win_rate": div(F.col("f_pos"), n_f), "flagged_weighted_return": if_both(wf),
        "flagged_weighted_return_se": if_both(w_se), "flagged_weighted_return_lcb": if_both(wf - Z * w_se),
        "weighted_mean_return_diff": if_both(wf - wu), "weighted_cohens_d": if_both(wd),
        "weighted_cohens_d_se": if_both(wd_se), "weighted_cohens_d_lcb": if_both(wd - Z * wd_se),
        "flagged_effective_count": if_both(eff_f), "unflagged_effective_count": if_both(eff_u)}
    return a.select(*by, *[c.alias(f"{prefix}_{n}") for n, c in cols.items()])


def winsorize(buys: DataFrame, by: list[str] = [], tail: float = 0.05, value: str = "trade_return") -> DataFrame:
    """Clip each flag group's returns to its [tail, 1 - tail] linear quantiles."""
    keys = [*by, "is_flagged"]
    q = exact_quantiles(buys, keys, {"x": F.col(value)}, (tail, 1.0 - tail)).groupBy(*keys).agg(
        F.min("quantile").alias("_lo"), F.max("quantile").alias("_hi"))
    return buys.join(q, keys).withColumn(
        value, F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(value)))).drop("_lo", "_hi")


def winsorized_metrics(buys: DataFrame, by: list[str] = [], tail: float = 0.05) -> DataFrame:
    m = trade_metrics(winsorize(buys, by, tail), by, prefix="w")
    keep = {"mean_return_diff": "mean_return_diff", "cohens_d": "cohens_d",
            "weighted_mean_return_diff": "weighted_mean_return_diff", "weighted_cohens_d": "weighted_cohens_d",
            "weighted_cohens_d_se": "weighted_cohens_d_se", "weighted_cohens_d_lcb": "weighted_cohens_d_lcb"}
    return m.select(*by, *[F.col(f"w_{c}").alias(f"trade_winsorized_{n}") for c, n in keep.items()])


def _fbeta(econ: Column, second: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when((econ > 0) & (second > 0), (1.0 + b2) * econ * second / (b2 * econ + second)).otherwise(0.0)


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def econ_fbeta(metrics: DataFrame, beta: float = 1.0, t_scale: float = 2.0, return_scale: float = 1.0) -> DataFrame:
    """Harmonic composites of an economic signal in [0, 1] and a detection score.

    Needs recall, f1, f0_5, mean_return_flagged, trade_flagged_win_rate,
    trade_flagged_mean_return and trade_t_stat.
    """
    win, mean = _unit(F.col("trade_flagged_win_rate")), _unit(F.col("mean_return_flagged"))
    soft = _unit(F.tanh(F.col("mean_return_flagged") / return_scale / 2.0))
    trade_soft = _unit(F.tanh(F.col("trade_flagged_mean_return") / return_scale / 2.0))
    t = _unit(F.tanh(F.col("trade_t_stat") / t_scale / 2.0))
    recall, f1, f05 = F.col("recall"), _unit(F.col("f1")), _unit(F.col("f0_5"))
    return metrics.withColumns({
        "econ_signal_winrate": win, "econ_signal_mean_return": mean, "econ_signal_return_sigmoid": soft,
        "econ_signal_trade_return_sigmoid": trade_soft, "econ_signal_t_stat": t,
        "f_beta_winrate": _fbeta(win, recall, beta), "f_beta_mean_return": _fbeta(mean, recall, beta),
        "f_beta_winrate_f1": _fbeta(win, f1, beta), "f_beta_mean_return_f1": _fbeta(mean, f1, beta),
        "f_beta_return_f1": _fbeta(soft, f1, beta), "f_beta_t_stat_f1": _fbeta(t, f1, beta),
        "f_beta_winrate_f0_5": _fbeta(win, f05, beta), "f_beta_mean_return_f0_5": _fbeta(mean, f05, beta),
        "f_beta_winrate_return": _fbeta(win, trade_soft, beta)})


def quality_composite(metrics: DataFrame) -> DataFrame:
    """F0.5 weighted by a bounded median profit."""
    return metrics.withColumn("quality", F.col("f0_5") * F.tanh(F.col("median_net_pnl_flagged") / 100.0))
