"""Wallet evaluations and how well flags recover the labelled wallets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.functions.stats import div
from tapescope.operators.quantiles import join_medians, medians


def wallet_evaluations(truth: DataFrame, suspicion: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Labels joined with what the replay saw of the wallet (nothing: zeros)."""
    seen = suspicion.select("market_id", "wallet", "suspicion", "num_flags")
    df = truth.join(seen, ["market_id", "wallet"], "left")
    if boosts is not None:
        df = df.join(boosts, ["market_id", "wallet"], "left")
    else:
        df = df.withColumns({"boost": F.lit(1.0), "has_common_ownership": F.lit(False)})
    return df.withColumns({
        "suspicion": F.coalesce("suspicion", F.lit(0.0)),
        "num_flags": F.coalesce("num_flags", F.lit(0).cast("long")),
        "boost": F.coalesce("boost", F.lit(1.0)),
        "has_common_ownership": F.coalesce("has_common_ownership", F.lit(False)),
    }).withColumns({"has_alert": F.col("num_flags") > 0,
                    "flag_rate": div(F.col("num_flags"), F.col("trade_count"))})


def predict(mode: str, suspicion_threshold: float = 1.0, flag_rate_threshold: Column | float = 0.5) -> Column:
    """Is the wallet predicted to be informed?"""
    if mode == "has_alert":
        return F.col("num_flags") > 0
    if mode == "suspicion_threshold":
        return F.col("suspicion") >= suspicion_threshold
    if mode in ("flag_rate", "boosted_flag_rate"):
        thr = flag_rate_threshold if isinstance(flag_rate_threshold, Column) else F.lit(flag_rate_threshold)
        return F.col("flag_rate") >= thr
    raise ValueError(f"unsupported prediction mode {mode!r}")


def confusion(predicted: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts, precision, recall and F-scores of ``predicted`` against ``is_insider``."""
    p, y = F.col("predicted"), F.col("is_insider")
    agg = predicted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_wallets"), F.count_if(p).alias("num_predicted"), F.count_if(y).alias("num_insiders"),
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"),
        F.count_if(~p & ~y).alias("tn"))
    return with_fscores(agg)


def with_fscores(agg: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def f(beta: float) -> Column:
        b2 = beta * beta
        return div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)

    return agg.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": f(1.0),
                            "f0_5": f(0.5), "f2": f(2.0)})


def classification_metrics(predicted: DataFrame, by: list[str] = []) -> DataFrame:
    """Confusion metrics plus the economics of the predicted wallets."""
    p = F.col("predicted")
    flagged = {"median_net_pnl_flagged": F.when(p, F.col("net_pnl")),
               "median_return_flagged": F.when(p, F.col("wallet_return")),
               "median_informed_score_flagged": F.when(p, F.col("informed_score"))}
    means = predicted.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(p, F.col("net_pnl"))), F.lit(0.0)).alias("mean_net_pnl_flagged"),
        F.coalesce(F.avg(F.when(p, F.col("wallet_return"))), F.lit(0.0)).alias("mean_return_flagged"))
    base = confusion(predicted, by)
    base = base.join(means, by) if by else base.crossJoin(means)
    return join_medians(base, predicted, by, flagged, default=0.0)


def cohort_of(predicted: DataFrame) -> DataFrame:
    """Explode each evaluated wallet into its cohorts: flagged and tp/fp, or fn."""
    p, y = F.col("predicted"), F.col("is_insider")
    cohorts = F.when(p & y, F.array(F.lit("flagged"), F.lit("tp"))).when(p, F.array(F.lit("flagged"), F.lit("fp"))).when(
        y, F.array(F.lit("fn"))).otherwise(F.array().cast("array<string>"))
    return predicted.withColumn("cohort", F.explode(cohorts))


def cohort_report(predicted: DataFrame, by: list[str] = []) -> DataFrame:
    """Count, returns and profit per cohort."""
    rows = cohort_of(predicted)
    keys = [*by, "cohort"]
    w = F.greatest(F.lit(0.0), F.col("gross_buy"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("wallet_return").alias("avg_return"),
        div(F.sum(F.col("wallet_return") * w), F.sum(w)).alias("weighted_return"),
        F.avg("net_pnl").alias("avg_net_pnl"), F.sum(w).alias("total_gross_buy"))
    return agg.join(medians(rows, keys, {"median_return": F.col("wallet_return"), "median_net_pnl": F.col("net_pnl")}), keys)


def market_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall and cohort returns per market."""
    p, y, r, w = F.col("predicted"), F.col("is_insider"), F.col("wallet_return"), F.greatest(F.lit(0.0), F.col("gross_buy"))
    z = F.lit(0.0)
    return predicted.groupBy("market_id").agg(
        F.count_if(p).alias("flagged_wallets"), F.count_if(y).alias("insider_wallets"), F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"),
        div(F.count_if(p & y), F.count_if(p)).alias("precision"), div(F.count_if(p & y), F.count_if(y)).alias("recall"),
        F.coalesce(F.avg(F.when(p, r)), z).alias("flagged_avg_return"),
        div(F.sum(F.when(p, r * w)), F.sum(F.when(p, w))).alias("flagged_weighted_return"),
        F.coalesce(F.avg(F.when(p & y, r)), z).alias("tp_avg_return"),
        F.coalesce(F.avg(F.when(p & ~y, r)), z).alias("fp_avg_return"),
        F.coalesce(F.avg(F.when(~p & y, r)), z).alias("fn_avg_return"),
        F.coalesce(F.avg(F.when(p, F.col("net_pnl"))), z).alias("flagged_avg_net_pnl"))


def detector_breakdown(scored: DataFrame) -> DataFrame:
    """Per (market, wallet): map detector -> alerts it took part in."""
    from tapescope.operators.scoring import fired
    rows = scored.where("is_alert").select("market_id", "wallet", F.explode(fired(scored)).alias("detector"))
    counts = rows.groupBy("market_id", "wallet", "detector").agg(F.count(F.lit(1)).alias("n"))
    # at most one entry per detector, so the collected list is bounded
    return counts.groupBy("market_id", "wallet").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("detector", "n")))).alias("detectors"))


def threshold_sweep(evaluations: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion metrics at many flag-rate thresholds from one evaluation table.

    Wallets are first reduced to counts per (flag_rate, label); the sweep then
    joins thresholds to those few rows.
    """
    hist = evaluations.groupBy("flag_rate", "is_insider").agg(F.count(F.lit(1)).alias("n"))
    rows = hist.crossJoin(F.broadcast(thresholds)).withColumn("predicted", F.col("flag_rate") >= F.col("threshold"))
    p, y, n = F.col("predicted"), F.col("is_insider"), F.col("n")

    def count(c: Column) -> Column:
        return F.sum(F.when(c, n).otherwise(0))

    agg = rows.groupBy("threshold").agg(
        F.sum("n").alias("num_wallets"), count(p).alias("num_predicted"), count(p & y).alias("tp"),
        count(p & ~y).alias("fp"), count(~p & y).alias("fn"), count(~p & ~y).alias("tn"))
    return with_fscores(agg)
