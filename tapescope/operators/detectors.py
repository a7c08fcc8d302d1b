"""Detectors: a confidence column (0 when silent) from strictly-prior state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.operators import state
from tapescope.operators.running import DAY_MS



def _logit(p: Column) -> Column:
    return F.when((p > 0.001) & (p < 0.999), F.log(p / (1.0 - p)))


def volume_z() -> Column:
    return F.when(F.col("base_std") >= 1e-6, (F.col("notional_usdc") - F.col("base_mean")) / F.col("base_std"))


def volume_anomaly(cfg: dict) -> Column:
    d = cfg["volume_anomaly"]
    z, thr = volume_z(), d["z_score_threshold"]
    fires = ((F.col("notional_usdc") >= d["min_absolute_notional"]) & ~state.is_flipper(cfg)
             & (F.col("base_n") >= d["min_trades_for_baseline"]) & (z >= thr))
    return F.when(fires, d["max_confidence"] / (1.0 + F.exp(-(z - thr) / 1.5))).otherwise(0.0)


def price_moves() -> tuple[Column, Column]:
    """Absolute move in probability and in log-odds since the outcome's last price."""
    prev, now = F.col("prev_price"), F.col("price")
    return F.abs(now - prev), F.abs(_logit(now) - _logit(prev))


def probability_impact(cfg: dict) -> Column:
    d = cfg["probability_impact"]
    dp, dlo = price_moves()
    eligible = (F.col("notional_usdc") >= d["min_notional"]) & F.col("prev_price").isNotNull() & (dp >= 1e-6)
    has_p = dp >= d["min_delta_prob"]
    has_lo = F.coalesce(dlo >= d["min_delta_log_odds"], F.lit(False))
    p_score = F.least(F.lit(1.0), dp / (2.0 * d["min_delta_prob"]))
    lo_score = F.least(F.lit(1.0), dlo / (2.0 * d["min_delta_log_odds"]))
    mixed = F.when(has_p & has_lo, 0.4 * p_score + 0.6 * lo_score).when(has_p, p_score).when(has_lo, lo_score)
    return F.coalesce(F.when(eligible, mixed * d["max_confidence"]), F.lit(0.0))


def accumulation(cfg: dict) -> Column:
    d = cfg["accumulation"]
    fires = ((F.col("side") == "BUY") & (F.col("w_trades") > 0)
             & (F.col("outcome_concentration") >= d["min_outcome_concentration"])
             & (F.col("outcome_directional") >= d["min_directional_ratio"])
             & (F.col("outcome_exposure") >= d["min_accumulation_usdc"]))
    return F.when(fires, F.col("outcome_directional") * d["max_confidence"]).otherwise(0.0)


def extreme_position(cfg: dict) -> Column:
    d = cfg["extreme_position"]
    tail, price = d["tail_threshold"], F.col("price")
    low = (price < tail) & (F.col("side") == "BUY")
    high = (price > 1.0 - tail) & (F.col("side") == "SELL")
    distance = F.when(low, tail - price).when(high, price - (1.0 - tail))
    score = (0.5 * F.least(F.lit(1.0), distance / tail)
             + 0.5 * F.least(F.lit(1.0), F.col("notional_usdc") / 5000.0))
    fires = (F.col("notional_usdc") >= d["min_notional"]) & ~state.is_flipper(cfg) & (low | high)
    return F.when(fires, score * d["max_confidence"]).otherwise(0.0)


def silence_ratio() -> Column:
    since = F.col("timestamp_ms") - F.col("contra_ts")
    return F.when(F.col("contra_gap_median") > 0, since / F.col("contra_gap_median"))


def contra_silence(cfg: dict) -> Column:
    d = cfg["contra_silence"]
    since = F.col("timestamp_ms") - F.col("contra_ts")
    ratio, thr = silence_ratio(), d["silence_threshold"]
    fires = ((F.col("notional_usdc") >= d["min_notional"]) & (since > 0)
             & (since <= d["max_contra_age_minutes"] * 60_000.0)
             & (F.col("contra_gap_n") >= d["min_gap_samples"]) & (ratio >= thr))
    return F.when(fires, F.least(F.lit(1.0), ratio / (2.0 * thr)) * d["max_confidence"]).otherwise(0.0)


def recidivism(cfg: dict, flags: Column) -> Column:
    """Confidence for a wallet with ``flags`` earlier alerts."""
    d = cfg["recidivism"]
    conf = d["max_confidence"] / (1.0 + F.exp(-d["k"] * (flags - d["midpoint"])))
    return F.when(flags >= d["min_prior_flags"], F.round(conf, 4)).otherwise(0.0)


def new_wallet(cfg: dict) -> Column:
    """Large trade of a wallet first seen less than an hour ago (or never)."""
    d = cfg["new_wallet"]
    age = F.col("timestamp_ms") - F.col("wallet_first_ts")
    young = F.col("wallet_first_ts").isNull() | (age < d["max_age_minutes"] * 60_000)
    return F.when((F.col("notional_usdc") >= d["min_notional"]) & young, F.round(F.lit(d["max_confidence"]), 4)).otherwise(0.0)


def cluster_coordination(cfg: dict) -> Column:
    """Needs the wallet's cluster columns (cluster_id null when in none)."""
    d = cfg["cluster_coordination"]
    bonus = (F.lit(d["base_confidence"])
             + F.when(F.col("cluster_size") >= d["size_threshold"], d["size_bonus"]).otherwise(0.0)
             + F.when(F.col("cluster_density") >= d["density_threshold"], d["density_bonus"]).otherwise(0.0)
             + F.when(F.col("has_common_ownership"), d["ownership_bonus"]).otherwise(0.0))
    return F.when(F.col("cluster_id").isNotNull(), F.least(bonus, F.lit(d["max_confidence"]))).otherwise(0.0)


# Order-book detectors work on ``bids`` (best first, falling) and ``asks``
# (best first, rising), arrays of (price, size).

def depth(levels: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(levels, keep) if keep else levels
    return F.aggregate(kept, F.lit(0.0), lambda acc, lv: acc + lv["size"])


def imbalance(bids: Column, asks: Column) -> Column:
    bid, ask = depth(bids), depth(asks)
    return F.when(ask < 1e-6, F.when(bid > 0, F.lit(float("inf"))).otherwise(1.0)).otherwise(bid / ask)


def spread_bps(bids: Column, asks: Column) -> Column:
    best_bid, best_ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    mid = (best_bid + best_ask) / 2.0
    return F.when(mid >= 1e-6, (best_ask - best_bid) / mid * 10_000.0)


def book_metrics(books: DataFrame, least_bid: float | None = None, most_ask: float | None = None) -> DataFrame:
    """Depths (also of bids from ``least_bid`` up and asks up to ``most_ask``), imbalance and spread per snapshot."""
    bids, asks = F.col("bids"), F.col("asks")
    out = {"bid_depth": depth(bids), "ask_depth": depth(asks), "imbalance": imbalance(bids, asks),
           "spread_bps": spread_bps(bids, asks)}
    if least_bid is not None:
        out["bid_depth_bounded"] = depth(bids, lambda lv: lv["price"] >= least_bid)
    if most_ask is not None:
        out["ask_depth_bounded"] = depth(asks, lambda lv: lv["price"] <= most_ask)
    return books.withColumns(out)


def _fill(levels: Column, size: Column) -> Column:
    """Walk the book until ``size`` is filled: levels touched, cost, tokens filled."""
    start = F.struct(size.alias("left"), F.lit(0).alias("n"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("got"))

    def step(acc: Column, lv: Column) -> Column:
        take = F.when(acc["left"] > 0, F.least(acc["left"], lv["size"])).otherwise(0.0)
        return F.struct((acc["left"] - take).alias("left"),
                        (acc["n"] + F.when(acc["left"] > 0, 1).otherwise(0)).alias("n"),
                        (acc["cost"] + lv["price"] * take).alias("cost"), (acc["got"] + take).alias("got"))

    return F.aggregate(levels, start, step)


def with_fill(df: DataFrame) -> DataFrame:
    """Add levels_consumed, slippage_bps for trades carrying a book."""
    side = F.when(F.col("side") == "BUY", F.col("asks")).otherwise(F.col("bids"))
    walked = df.withColumn("_levels", side).withColumn("_fill", _fill(F.col("_levels"), F.col("size_tokens")))
    best = F.get(F.col("_levels"), F.lit(0))["price"]
    got = F.col("_fill.got")
    return walked.withColumns({
        "levels_consumed": F.coalesce(F.col("_fill.n"), F.lit(0)),
        "slippage_bps": F.when(got > 0, F.abs((F.col("_fill.cost") / got - best) / best) * 10_000.0),
    }).drop("_levels", "_fill")


def orderbook_consumption(cfg: dict) -> Column:
    d = cfg["orderbook_consumption"]
    n, slip = F.col("levels_consumed"), F.col("slippage_bps")
    score = 0.5 * F.least(F.lit(1.0), n / 10.0) + 0.5 * F.least(F.lit(1.0), slip / d["max_slippage_bps"])
    fires = (F.col("notional_usdc") >= d["min_notional"]) & (n >= d["min_levels_consumed"]) & slip.isNotNull()
    return F.when(fires, score * d["max_confidence"]).otherwise(0.0)


def orderbook_imbalance(cfg: dict) -> Column:
    d = cfg["orderbook_imbalance"]
    r, ratio = d["min_imbalance_ratio"], imbalance(F.col("bids"), F.col("asks"))
    against_bid = (F.col("side") == "SELL") & (ratio > r)
    against_ask = (F.col("side") == "BUY") & (ratio < 1.0 / r)
    part = F.when(against_bid, F.least(F.lit(1.0), ratio / (2.0 * r))).when(
        against_ask, F.when(ratio > 0, F.least(F.lit(1.0), (1.0 / ratio) / (2.0 * r))).otherwise(1.0))  # no bids at all: as heavy as can be
    score = 0.6 * part + 0.4 * F.least(F.lit(1.0), F.col("notional_usdc") / 3000.0)
    fires = ((F.col("notional_usdc") >= d["min_notional"]) & F.col("bids").isNotNull()
             & (against_bid | against_ask))
    return F.when(fires, score * d["max_confidence"]).otherwise(0.0)


def thin_liquidity(cfg: dict) -> Column:
    d = cfg["thin_liquidity"]
    bid, ask = depth(F.col("bids")), depth(F.col("asks"))
    total = bid + ask
    side = F.when(F.col("side") == "BUY", ask).otherwise(bid)
    ratio = F.when(side > 0, F.col("size_tokens") / side).otherwise(0.0)
    score = 0.5 * (1.0 - total / d["max_total_depth"]) + 0.5 * F.least(F.lit(1.0), ratio / 0.5)
    fires = ((F.col("notional_usdc") >= d["min_notional"]) & F.col("bids").isNotNull()
             & (total < d["max_total_depth"]) & (ratio >= d["min_depth_ratio"]))
    return F.when(fires, score * d["max_confidence"]).otherwise(0.0)


# name -> confidence column, in the order they are reported
TAPE_DETECTORS: dict[str, Callable[[dict], Column]] = {
    "volume_anomaly": volume_anomaly,
    "probability_impact": probability_impact,
    "accumulation": accumulation,
    "extreme_position": extreme_position,
    "contra_silence": contra_silence,
}
BOOK_DETECTORS: dict[str, Callable[[dict], Column]] = {
    "orderbook_consumption": orderbook_consumption,
    "orderbook_imbalance": orderbook_imbalance,
    "thin_liquidity": thin_liquidity,
}


def with_state(tape: DataFrame, cfg: dict, chunk_ms: int = DAY_MS) -> DataFrame:
    """All state columns the tape detectors read."""
    df = state.wallet_ratios(state.wallet_state(tape, chunk_ms))
    df = state.market_state(df, tape, chunk_ms)
    df = state.with_baseline(df, tape, cfg, chunk_ms)
    return state.contra_gaps(df, tape, chunk_ms)


def detect(df: DataFrame, cfg: dict, names: list[str] | None = None) -> DataFrame:
    """Add ``conf_<name>`` for the named detectors."""
    every = {**TAPE_DETECTORS, **BOOK_DETECTORS}
    return df.withColumns({f"conf_{n}": every[n](cfg) for n in (names or list(TAPE_DETECTORS))})
