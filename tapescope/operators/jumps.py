"""Price jumps and the wallets that anticipate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.operators.running import DAY_MS, MINUTE_MS, Track, running


def find_jumps(trades: DataFrame, cfg: dict, keys: list[str] = ["market_id"], chunk_ms: int = DAY_MS) -> DataFrame:
    """Per outcome: moves of at least the threshold between a trade and the last
    trade of its forward window.

    "Last trade at or before t + window" is asked by placing a probe row there;
    the running last price answers it, so there is no range join.
    """
    j = cfg["jumps"]
    window = int(j["jump_window_minutes"] * MINUTE_MS)
    cell = [*keys, "outcome_index"]
    point = F.struct(F.col("timestamp_ms").alias("t"), F.col("price").alias("p"))
    marks = trades.select(*cell, F.col("timestamp_ms").alias("_t"), F.lit(0).alias("_probe"),
                          F.col("price").alias("_p"), "seq", point.alias("_point"))
    probes = trades.select(*cell, (F.col("timestamp_ms") + window).alias("_t"), F.lit(1).alias("_probe"),
                           F.col("price").alias("_p"), "seq", F.col("timestamp_ms").alias("start_ms"))
    both = marks.unionByName(probes, allowMissingColumns=True)
    seen = running(both, cell, ["_t", "_probe", "_p", "seq"], [Track("_last", "last", F.col("_point"))], chunk_ms)
    change = F.col("_last.p") - F.col("_p")
    return (seen.where("_probe = 1").select(*cell, "start_ms", F.col("_last.t").alias("end_ms"), change.alias("price_change"))
            .where(F.abs("price_change") >= j["jump_threshold"])
            .withColumn("direction", F.when(F.col("price_change") > 0, 1).otherwise(-1)))


def next_jump(trades: DataFrame, jumps: DataFrame, cfg: dict, keys: list[str] = ["market_id"]) -> DataFrame:
    """Add ``jump_direction``: the largest jump starting in [ts, ts + look-ahead].

    Ties go to the earliest start, then the falling one.  Time is cut into
    slots of the look-ahead's length: the interval then covers the rest of its
    own slot and the head of the next, so the maximum is a running maximum from
    either end instead of a sliding one, and the work stays linear.
    """
    look = int(cfg["jumps"]["pre_jump_lookback_minutes"] * MINUTE_MS)
    cell = [*keys, "outcome_index"]
    rank = F.struct(F.abs("price_change").alias("a"), (-F.col("start_ms")).alias("s"), (-F.col("direction")).alias("d"))
    marks = jumps.select(*cell, F.floor(F.col("start_ms") / look).alias("_slot"), F.col("start_ms").alias("_t"),
                         F.lit(0).alias("_ask"), rank.alias("_rank"))
    rest = trades.select(*cell, "seq", F.floor(F.col("timestamp_ms") / look).alias("_slot"),
                         F.col("timestamp_ms").alias("_t"), F.lit(1).alias("_ask"))
    head = trades.select(*cell, "seq", (F.floor(F.col("timestamp_ms") / look) + 1).alias("_slot"),
                         (F.col("timestamp_ms") + look).alias("_t"), F.lit(2).alias("_ask"))
    both = marks.unionByName(rest, allowMissingColumns=True).unionByName(head, allowMissingColumns=True).withColumn("_back", -F.col("_t"))
    # a busy slot is itself a prefix scan over finer chunks, from either end
    slot, fine = [*cell, "_slot"], max(1, look // 16)
    found = running(both, slot, ["_t", "_ask"], [Track("_head", "max", F.col("_rank"))], fine, inclusive=True)
    found = running(found, slot, ["_back", "_ask"], [Track("_rest", "max", F.col("_rank"))], fine, inclusive=True, source=both)
    hit = (found.where("_ask > 0").groupBy(*keys, "seq")
           .agg(F.max(F.when(F.col("_ask") == 1, F.col("_rest")).otherwise(F.col("_head"))).alias("_best")))
    return trades.join(hit, [*keys, "seq"], "left").withColumn("jump_direction", -F.col("_best.d")).drop("_best")


def score_jump_wallets(trades: DataFrame, jumps: DataFrame, cfg: dict, keys: list[str] = ["market_id"]) -> DataFrame:
    """Boost per wallet from how often its trades point at the coming jump."""
    j = cfg["jumps"]
    rows = next_jump(trades.where(F.col("notional_usdc") >= j["min_trade_notional"]), jumps, cfg, keys)
    side = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    agg = rows.groupBy(*keys, "wallet").agg(
        F.count(F.lit(1)).alias("n_total"), F.count("jump_direction").alias("n_pre"),
        F.count_if(F.col("jump_direction") == side).alias("n_aligned"))
    return agg.withColumn("jump_boost", F.when(F.col("n_pre") >= j["min_pre_jump_trades"], boost_of(cfg)).otherwise(1.0))


def boost_of(cfg: dict) -> Column:
    """From n_total, n_pre and n_aligned: how much better than chance, and how often."""
    excess = F.greatest(F.lit(0.0), (F.col("n_aligned") / F.col("n_pre") - 0.5) * 2.0)
    return 1.0 + (cfg["jumps"]["max_boost_factor"] - 1.0) * (excess * (F.col("n_pre") / F.col("n_total")))


def apply_jump_boost(boosts: DataFrame, scores: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """Multiply wallet boosts by jump boosts above 1.001."""
    s = scores.where("jump_boost > 1.001").select(*keys, "wallet", "jump_boost")
    out = boosts.join(s, [*keys, "wallet"], "full")
    return out.withColumn("boost", F.coalesce("boost", F.lit(1.0)) * F.coalesce("jump_boost", F.lit(1.0)))


def jump_boost_summary(jumps: DataFrame, scores: DataFrame) -> DataFrame:
    n = jumps.agg(F.count(F.lit(1)).alias("n_jumps"))
    up = F.col("jump_boost") > 1.001
    s = scores.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(up).alias("n_boosted"),
                   F.coalesce(F.avg(F.when(up, F.col("jump_boost"))), F.lit(1.0)).alias("mean_boost"),
                   F.coalesce(F.max("jump_boost"), F.lit(1.0)).alias("max_boost"))
    return n.crossJoin(s)


def largest_price_jump(tape: DataFrame, winners: DataFrame, positive_only: bool = False, chunk_ms: int = DAY_MS) -> DataFrame:
    """Biggest single-step rise of the winning outcome's price; earliest wins ties."""
    from tapescope.operators.state import ORDER
    won = tape.join(winners, "market_id").where(F.col("outcome_index") == F.col("winner"))
    steps = running(won.select("market_id", *ORDER, "price"), ["market_id"], ORDER,
                    [Track("_prev", "last", F.col("price"))], chunk_ms)
    steps = steps.where("_prev is not null").withColumn("rise", F.col("price") - F.col("_prev"))
    if positive_only:
        steps = steps.where("rise > 0")
    rank = F.struct("rise", (-F.col("timestamp_ms")).alias("t"), (-F.col("seq")).alias("s"))
    return steps.groupBy("market_id").agg(F.max("rise").alias("rise"), F.max_by("timestamp_ms", rank).alias("jump_ts"))


