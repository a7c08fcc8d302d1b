"""Scores, alerts and the replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.operators import detectors as det
from tapescope.operators.running import DAY_MS, Track, running
from tapescope.operators.state import ORDER, is_buy, signed_tokens
from tapescope.session import cut


def conf_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("conf_")]


def noisy_or(columns: list[Column]) -> Column:
    """Chance that at least one of the independent signals is right."""
    return F.lit(1.0) - reduce(lambda acc, c: acc * (F.lit(1.0) - c), columns, F.lit(1.0))


def boosted(score: Column, multiplier: Column, cap: float) -> Column:
    """Score times a single-precision multiplier, capped for every trade."""
    return F.least(score * multiplier.cast("float").cast("double"), F.lit(cap))


def score(df: DataFrame, cfg: dict, multiplier: Column | None = None) -> DataFrame:
    """Add base_score, total_score and is_alert from the ``conf_*`` columns."""
    base = noisy_or([F.col(c) for c in conf_columns(df)])
    df = df.withColumn("base_score", base)
    total = F.col("base_score") if multiplier is None else boosted(F.col("base_score"), multiplier, cfg["score_cap"])
    return df.withColumn("total_score", total).withColumn(
        "is_alert", F.col("total_score") >= cfg["alert_threshold"])


def fired(df: DataFrame) -> Column:
    """Names of the detectors that fired, in report order."""
    return F.filter(F.array(*[
        F.when(F.col(c) > 0, F.lit(c.removeprefix("conf_"))) for c in conf_columns(df)]), lambda x: x.isNotNull())


def replay(tape: DataFrame, cfg: dict, multiplier: Column | None = None, chunk_ms: int = DAY_MS) -> DataFrame:
    """State, detectors, score and alert flag for every trade of every market."""
    return score(det.detect(det.with_state(tape, cfg, chunk_ms), cfg), cfg, multiplier)


def recidivism_replay(scored: DataFrame, cfg: dict, key: list[str] = ["market_id", "wallet"]) -> DataFrame:
    """Let earlier alerts of a wallet in a market raise its later scores.

    A trade's outcome depends on the wallet's alert count so far, but only
    through the smallest count ``need`` that makes it an alert (0 when it is one
    anyway, none when no count suffices).  The count's effect stops changing at
    a small ``top`` (the sigmoid is rounded to 4 digits).  So instead of walking
    a wallet's trades one by one, find when the count reaches 1, 2, .. top: one
    aggregation per step over the trades that can still matter, whatever the
    length of the wallet's history.  Needs base_score and (optionally) multiplier.
    """
    d = cfg["recidivism"]
    top = _saturation(d)
    mult = F.col("multiplier") if "multiplier" in scored.columns else None

    def at(flags: int) -> Column:
        c = _sigmoid(d, flags) if flags >= d["min_prior_flags"] else 0.0
        s = noisy_or([F.col("base_score"), F.lit(c)])
        return s if mult is None else boosted(s, mult, cfg["score_cap"])

    thr = cfg["alert_threshold"]
    need = F.coalesce(*[F.when(at(n) >= thr, F.lit(n)) for n in range(top + 1)])
    df = scored.withColumn("_need", need)
    able = cut(df.where("_need is not null").select(*key, F.struct(*ORDER).alias("_at"), "_need"))
    # step n finds, for every wallet still climbing, the alert that takes its count to n
    step = cut(able.where("_need = 0").groupBy(*key).agg(F.min("_at").alias("_hit")))
    found = []
    for n in range(1, top + 1):
        if step.isEmpty():
            break
        found.append(step.withColumn("_n", F.lit(n)))
        if n < top:
            step = cut(able.where(F.col("_need") <= n).join(step, key).where(F.col("_at") > F.col("_hit"))
                       .groupBy(*key).agg(F.min("_at").alias("_hit")))
    if found:
        steps = reduce(DataFrame.unionByName, found)
        # at most ``top`` entries per wallet
        reached = steps.groupBy(*key).agg(F.collect_list("_hit").alias("_hits"))
        before = F.size(F.filter(F.coalesce("_hits", F.array()), lambda h: h < F.struct(*ORDER)))
        out = df.join(reached, key, "left").withColumn("prior_flags_capped", before).drop("_hits")
    else:
        out = df.withColumn("prior_flags_capped", F.lit(0))
    conf = F.lit(0.0)
    for n in range(top, 0, -1):
        if n >= d["min_prior_flags"]:
            conf = F.when(F.col("prior_flags_capped") == n, _sigmoid(d, n)).otherwise(conf)
    out = out.withColumn("conf_recidivism", conf)
    total = noisy_or([F.col("base_score"), F.col("conf_recidivism")])
    total = total if mult is None else boosted(total, mult, cfg["score_cap"])
    return (out.withColumn("total_score", total).withColumn("is_alert", F.col("total_score") >= thr)
            .drop("_need"))


def _sigmoid(d: dict, flags: int) -> float:
    import math
    return round(d["max_confidence"] / (1.0 + math.exp(-d["k"] * (flags - d["midpoint"]))), 4)


def _saturation(d: dict) -> int:
    """Smallest count from which the rounded confidence no longer changes."""
    limit, n = round(float(d["max_confidence"]), 4), int(d["min_prior_flags"])
    while _sigmoid(d, n) != limit:
        n += 1
    return max(n, 1)


def prior_flags(scored: DataFrame, key: list[str] = ["market_id", "wallet"], chunk_ms: int = DAY_MS) -> DataFrame:
    """Exact number of earlier alerts of the wallet in the market."""
    return running(scored, key, ORDER, [Track("prior_flags", "sum", F.col("is_alert").cast("long"))], chunk_ms)


def trade_features(scored: DataFrame) -> DataFrame:
    """Wide per-trade row: features, one confidence per detector, alert flag."""
    confs = conf_columns(scored)
    n_fired = reduce(lambda a, b: a + b, [F.when(F.col(c) > 0, 1).otherwise(0) for c in confs])
    return scored.select("market_id", "seq", "wallet", "timestamp_ms", "notional_usdc", "price", "side",
                         "outcome_index", "total_score", n_fired.alias("num_detectors_fired"),
                         F.col("is_alert").cast("int").alias("is_alert"), *confs)


def alerts(scored: DataFrame) -> DataFrame:
    """Trades at or above the threshold, with the signals that fired."""
    confs = conf_columns(scored)
    signal = F.filter(F.array(*[
        F.when(F.col(c) > 0, F.struct(F.lit(c.removeprefix("conf_")).alias("detector"), F.col(c).alias("confidence")))
        for c in confs]), lambda x: x.isNotNull())
    return scored.where("is_alert").select(
        "market_id", "seq", "wallet", "timestamp_ms", "side", "outcome_index", "price", "notional_usdc",
        "size_tokens", "tx_hash", "total_score", signal.alias("signals"))


def detector_stats(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """Fires per detector, as (detector, fires) rows."""
    confs = conf_columns(scored)
    wide = scored.groupBy(*by).agg(*[F.count_if(F.col(c) > 0).alias(c.removeprefix("conf_")) for c in confs])
    return wide.unpivot(by, [c.removeprefix("conf_") for c in confs], "detector", "fires")


def wallet_suspicion(scored: DataFrame, by: list[str] = ["market_id", "wallet"]) -> DataFrame:
    """Per wallet: summed score, flags, trades, notional, positions and costs."""
    agg = [F.sum("total_score").alias("suspicion"), F.count_if("is_alert").alias("num_flags"),
           F.count(F.lit(1)).alias("trade_count"), F.sum("notional_usdc").alias("notional"),
           F.sum(F.when(is_buy(), F.col("notional_usdc")).otherwise(0.0)).alias("gross_buy")]
    for o in (0, 1):
        here = F.col("outcome_index") == o
        agg += [F.sum(F.when(here, signed_tokens()).otherwise(0.0)).alias(f"shares{o}"),
                F.sum(F.when(here & is_buy(), F.col("notional_usdc"))
                      .when(here, -F.col("notional_usdc")).otherwise(0.0)).alias(f"cost{o}")]
    return scored.groupBy(*by).agg(*agg)


def rescore(frozen: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alerts, alert rate and flagged wallets at many thresholds in one pass.

    ``thresholds`` is a small driver-made table (column ``threshold``).
    """
    n = frozen.crossJoin(F.broadcast(thresholds))
    hit = F.col("total_score") >= F.col("threshold")
    return n.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(hit).alias("alerts"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("alert_rate"))


def replace_detector(frozen: DataFrame, cfg: dict, name: str) -> DataFrame:
    """Recompute one detector on stored state, keep the other confidences."""
    every = {**det.TAPE_DETECTORS, **det.BOOK_DETECTORS}
    base = frozen.withColumn(f"conf_{name}", every[name](cfg)).drop("base_score", "total_score", "is_alert")
    return score(base, cfg)
