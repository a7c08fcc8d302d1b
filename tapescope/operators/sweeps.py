"""Sweeps, ablations, counterfactuals and parameter search.

A candidate setting is a column, never a loop over jobs: thresholds, ablation
variants and parameter grids are small driver-made tables joined to signals that
were computed once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.functions.stats import div
from tapescope.operators import evaluation, scoring
from tapescope.operators.quantiles import join_medians


def param_grid(spark: SparkSession, values: dict[str, list[float]]) -> DataFrame:
    """All combinations of the given values, numbered."""
    rows = [(i, *map(float, combo)) for i, combo in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, "candidate long, " + ", ".join(f"{k} double" for k in values))


def sample_grid(grid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A seeded random sample of a (small) grid."""
    return grid.orderBy(F.xxhash64("candidate", F.lit(seed)), "candidate").limit(n)


def perturb(grid: DataFrame, columns: list[str], scale: float = 0.1, seed: int = 42) -> DataFrame:
    """Every value moved by up to ``scale`` of itself, by a seeded hash."""
    def shift(c: str) -> Column:
        u = F.pmod(F.xxhash64("candidate", F.lit(c), F.lit(seed)), F.lit(10_001)) / 5000.0 - 1.0
        return F.col(c) * (1.0 + scale * u)
    return grid.withColumns({c: shift(c) for c in columns})


def min_notional_sweep(tape: DataFrame, cfg: dict, cutoffs: list[float]) -> DataFrame:
    """Replay the tape once per minimum notional, as one plan.

    Each cut-off is a separate set of markets: the market key carries it.
    """
    spark = tape.sparkSession
    c = F.broadcast(spark.createDataFrame([(i, float(x)) for i, x in enumerate(cutoffs)], "_i int, min_usd double"))
    kind = tape.schema["market_id"].dataType
    rows = (tape.crossJoin(c).where(F.col("notional_usdc") >= F.col("min_usd"))
            .withColumn("market_id", F.concat_ws("|", "_i", F.col("market_id").cast("string"))).drop("_i"))
    out = scoring.replay(rows, cfg)
    return out.withColumn("market_id", F.regexp_replace("market_id", "^[0-9]+[|]", "").cast(kind))


def ablation(frozen: DataFrame, cfg: dict) -> DataFrame:
    """Alerts of the full system and with each detector silenced, and the change."""
    confs = scoring.conf_columns(frozen)
    variants = {"full": confs, **{f"no_{c.removeprefix('conf_')}": [x for x in confs if x != c] for c in confs}}
    hit = {v: scoring.noisy_or([F.col(c) for c in cols]) >= cfg["alert_threshold"] for v, cols in variants.items()}
    wide = frozen.agg(F.count(F.lit(1)).alias("trades"), *[F.count_if(h).alias(v) for v, h in hit.items()])
    rows = wide.unpivot(["trades", F.col("full").alias("full_alerts")], list(hit), "variant", "alerts")
    return rows.select("variant", "trades", "alerts", (F.col("alerts") - F.col("full_alerts")).alias("alerts_delta"))


def detector_diagnostics(buys: DataFrame, frozen: DataFrame) -> DataFrame:
    """Per detector: fires, its alerts (alone or not) and what its flagged BUYs made."""
    fires = scoring.detector_stats(frozen)
    names = scoring.fired(frozen)
    alerts = (frozen.where("is_alert").select(F.explode(names).alias("detector"), F.size(names).alias("_n"))
              .groupBy("detector").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("_n") == 1).alias("alone")))
    made = (buys.where("is_flagged").withColumn("detector", F.explode("flag_detectors")).groupBy("detector")
            .agg(F.count(F.lit(1)).alias("flagged_buys"), F.sum("pnl").alias("pnl"), F.avg("trade_return").alias("mean_return")))
    return fires.join(alerts, "detector", "left").join(made, "detector", "left").fillna(0)


def wallet_counterfactual(with_c: DataFrame, without: DataFrame) -> DataFrame:
    """Flags of each wallet with and without the boosts: decisive, suppressed, change."""
    a = with_c.select("market_id", "wallet", F.col("num_flags").alias("flags_with"))
    b = without.select("market_id", "wallet", F.col("num_flags").alias("flags_without"))
    df = a.join(b, ["market_id", "wallet"], "full").fillna(0, ["flags_with", "flags_without"])
    return df.withColumns({
        "decisive": (F.col("flags_with") > 0) & (F.col("flags_without") == 0),
        "suppressed": (F.col("flags_with") == 0) & (F.col("flags_without") > 0),
        "alerts_delta": F.col("flags_with") - F.col("flags_without")})


def cohort_economics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Wallets, profit and precision per cohort; grouping sets give the totals."""
    agg = [F.count(F.lit(1)).alias("wallets"), F.sum("net_pnl").alias("net_pnl"), F.avg("wallet_return").alias("mean_return"),
           F.count_if("is_insider").alias("insiders")]
    return rows.cube(*by).agg(*agg)


def trade_counterfactual(buys: DataFrame) -> DataFrame:
    """BUY trades by how a boost mattered; needs base_hit, boosted_hit, multiplier."""
    base, hit, boosted = F.col("base_hit"), F.col("boosted_hit"), F.col("multiplier") > 1.0
    groups = F.filter(F.array(
        F.when(hit & ~base, F.lit("boosted_into_alert")), F.when(hit & base & boosted, F.lit("boosted_anyway")),
        F.when(boosted, F.lit("any_boost")), F.when(~hit, F.lit("not_flagged"))), lambda x: x.isNotNull())
    rows = buys.withColumn("cohort", F.explode(groups))
    return rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"), F.avg("trade_return").alias("mean_return"),
        (F.count_if("is_win") / F.count(F.lit(1))).alias("win_rate"))


def cluster_returns(truth: DataFrame, member: DataFrame) -> DataFrame:
    """Per cluster: wallets, gross, profit, returns, best wallet, label precision."""
    m = member.select("market_id", F.col("node").alias("wallet"), "community")
    rows = truth.join(m, ["market_id", "wallet"])
    keys = ["market_id", "community"]
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("wallets"), F.sum("gross_buy").alias("gross_buy"), F.sum("net_pnl").alias("net_pnl"),
        F.avg("wallet_return").alias("mean_return"), div(F.sum(F.col("wallet_return") * F.col("gross_buy")), F.sum("gross_buy")).alias("weighted_return"),
        F.max_by("wallet", F.struct(F.col("net_pnl"), F.col("wallet"))).alias("peak_wallet"),
        (F.count_if("is_insider") / F.count(F.lit(1))).alias("insider_precision"))
    return join_medians(agg, rows, keys, {"median_return": F.col("wallet_return")})


def slice_metrics(predicted: DataFrame, classes: DataFrame) -> DataFrame:
    """Confusion metrics per slice: all markets, plausible ones, each category."""
    c = classes.select("market_id", F.filter(F.array(
        F.lit("all"), F.when(F.col("insider_plausible"), F.lit("plausible")), F.col("category")), lambda x: x.isNotNull()).alias("_s"))
    rows = predicted.join(c, "market_id").withColumn("slice", F.explode("_s"))
    return evaluation.confusion(rows, ["slice"])


def domain_matrix(evals: DataFrame, classes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pick the best flag-rate threshold in each train domain, score it in every test domain."""
    rows = evals.join(classes.select("market_id", "category"), "market_id")
    hist = rows.groupBy("category", "flag_rate", "is_insider").agg(F.count(F.lit(1)).alias("n"))
    p, y, n = F.col("flag_rate") >= F.col("threshold"), F.col("is_insider"), F.col("n")

    def count(c: Column) -> Column:
        return F.sum(F.when(c, n).otherwise(0))

    per = evaluation.with_fscores(hist.crossJoin(F.broadcast(thresholds)).groupBy("category", "threshold").agg(
        count(p & y).alias("tp"), count(p & ~y).alias("fp"), count(~p & y).alias("fn")))
    best = per.groupBy("category").agg(F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t"))).alias("threshold")).withColumnRenamed("category", "train")
    return best.join(per.withColumnRenamed("category", "test"), "threshold").select("train", "test", "threshold", "f1")


def evaluate_candidates(frozen: DataFrame, truth: DataFrame, grid: DataFrame, detectors: list[str]) -> DataFrame:
    """Wallet metrics of every candidate on shared signals.

    A candidate scales each detector's confidence (``w_<detector>``) and sets
    alert_threshold and flag_rate.  Only trades that some detector fired on are
    multiplied by the candidates; the silent rest only adds to trade counts.
    """
    scaled = [F.col(f"conf_{d}") * F.col(f"w_{d}") for d in detectors]
    live = frozen.where(reduce(lambda a, b: a | b, [F.col(f"conf_{d}") > 0 for d in detectors]))
    hits = (live.crossJoin(F.broadcast(grid)).where(scoring.noisy_or(scaled) >= F.col("alert_threshold"))
            .groupBy("candidate", "market_id", "wallet").agg(F.count(F.lit(1)).alias("num_flags")))
    rates = (hits.join(truth, ["market_id", "wallet"]).join(F.broadcast(grid.select("candidate", "flag_rate")), "candidate")
             .withColumn("predicted", F.col("num_flags") / F.col("trade_count") >= F.col("flag_rate")))
    found = rates.groupBy("candidate").agg(F.count_if(F.col("predicted") & F.col("is_insider")).alias("tp"),
                                           F.count_if(F.col("predicted") & ~F.col("is_insider")).alias("fp"))
    total = truth.agg(F.count(F.lit(1)).alias("num_wallets"), F.count_if("is_insider").alias("num_insiders"))
    agg = grid.select("candidate").join(found, "candidate", "left").fillna(0, ["tp", "fp"]).crossJoin(total)
    return evaluation.with_fscores(agg.withColumn("fn", F.col("num_insiders") - F.col("tp")))


def coordinate_descent(evaluate: Callable[[DataFrame], DataFrame], spark: SparkSession, start: dict[str, float],
                       groups: list[dict[str, list[float]]], objective: str = "f1", passes: int = 2) -> tuple[dict[str, float], list[tuple]]:
    """Per group of parameters keep the best candidate (strictly better only).

    Each step is one job over a whole group; the driver keeps the winner only.
    """
    best, score, log = dict(start), -1.0, []
    for p in range(passes):
        improved = False
        for g, group in enumerate(groups):
            grid = param_grid(spark, {k: group.get(k, [v]) for k, v in best.items()})
            top = evaluate(grid).orderBy(F.desc(objective), "candidate").limit(1).join(grid, "candidate").first()
            if top is not None and top[objective] > score + 1e-12:
                best, score, improved = {k: top[k] for k in best}, float(top[objective]), True
            log.append((p, g, score))
        if not improved:
            break
    return best, log


def multi_start_summary(runs: DataFrame) -> DataFrame:
    """Best start, spread of the objective and the train-validation gap."""
    return runs.agg(F.max_by("start_id", F.struct("train_score", (-F.col("start_id")).alias("s"))).alias("best_start"), F.min("train_score").alias("min_score"),
                    F.percentile("train_score", F.lit(0.5)).alias("median_score"), F.max("train_score").alias("max_score"),
                    (F.max("train_score") - F.min("train_score")).alias("spread"),
                    F.avg(F.col("train_score") - F.col("val_score")).alias("mean_gap"))


def coarse_markets(counts: DataFrame, cap: int) -> DataFrame:
    """Markets with at most ``cap`` trades, else the smallest one."""
    small = counts.where(F.col("n_trades") <= cap)
    least = counts.orderBy("n_trades", "market_id").limit(1)
    none = small.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return small.unionByName(least.crossJoin(none).where("_none").drop("_none"))


def reported_recall(reported: DataFrame, stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per reported wallet: traded at all, flags, flag rate, classified."""
    s = stats.select("market_id", "wallet", "trade_count", "num_flags")
    df = reported.join(s, ["market_id", "wallet"], "left")
    rate = div(F.col("num_flags"), F.col("trade_count"))
    return df.withColumns({"present": F.col("trade_count").isNotNull(), "num_flags": F.coalesce("num_flags", F.lit(0).cast("long")),
                           "flag_rate": rate, "any_flag": F.coalesce(F.col("num_flags") > 0, F.lit(False)), "classified": F.coalesce(rate >= threshold, F.lit(False)) & F.col("trade_count").isNotNull()})


def recall_summary(per_wallet: DataFrame, by: list[str] = []) -> DataFrame:
    p = F.col("present")
    return per_wallet.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reported"), F.countDistinct("wallet").alias("unique_wallets"), F.count_if(p).alias("present"), F.count_if("any_flag").alias("any_flag"),
        F.count_if("classified").alias("classified"), div(F.count_if("any_flag"), F.count_if(p)).alias("any_flag_recall"),
        div(F.count_if("classified"), F.count_if(p)).alias("classified_recall"))


def label_recall(flag_states: DataFrame, truth: DataFrame) -> DataFrame:
    """Per method: tp/fp/fn of "any flag" and of "classified" against the labels."""
    methods = flag_states.select("method").distinct()
    base = truth.select("market_id", "wallet", "is_insider").crossJoin(F.broadcast(methods))
    df = base.join(flag_states, ["method", "market_id", "wallet"], "left")
    y, a, c = F.col("is_insider"), F.coalesce("any_flag", F.lit(False)), F.coalesce("classified", F.lit(False))
    return df.groupBy("method").agg(*[
        F.count_if(cond).alias(f"{n}_{k}") for n, x in (("any", a), ("classified", c))
        for k, cond in (("tp", x & y), ("fp", x & ~y), ("fn", ~x & y))], F.coalesce(F.sum("num_flags"), F.lit(0).cast("long")).alias("flag_volume"))
