"""State a detector may look at: everything strictly before the current trade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapescope.operators.running import DAY_MS, HOUR_MS, Track, departed_sums, row_blocks, running
from tapescope.operators.scan import ranged

ORDER = ["timestamp_ms", "seq"]
GAP_RING = 200
GAP_BLOCK = 20_000


def is_buy() -> Column:
    return F.col("side") == "BUY"


def signed_tokens() -> Column:
    return F.when(is_buy(), F.col("size_tokens")).otherwise(-F.col("size_tokens"))


def market_state(tape: DataFrame, source: DataFrame | None = None, chunk_ms: int = DAY_MS) -> DataFrame:
    """Per market, before each trade: trade count and sums, previous time, and
    the last price and time of either outcome.

    ``source`` (default: ``tape``) is the raw tape the chunk totals are read from.
    """
    x = F.col("notional_usdc")
    tracks = [Track("market_trades_before", "sum", F.lit(1).cast("long")),
              Track("_sum_x", "sum", x), Track("_sum_xx", "sum", x * x),
              Track("market_prev_ts", "max", F.col("timestamp_ms"))]
    for o in (0, 1):
        here = F.col("outcome_index") == o
        tracks += [Track(f"_price{o}", "last", F.when(here, F.col("price"))),
                   Track(f"_ts{o}", "max", F.when(here, F.col("timestamp_ms")))]
    df = running(tape, ["market_id"], ORDER, tracks, chunk_ms, source=source)
    zero, one = F.col("outcome_index") == 0, F.col("outcome_index") == 1

    def own(a: str) -> Column:
        return F.when(zero, F.col(f"{a}0")).when(one, F.col(f"{a}1"))

    def contra(a: str) -> Column:
        return F.when(zero, F.col(f"{a}1")).when(one, F.col(f"{a}0"))

    return df.withColumns({
        "prev_price": own("_price"), "own_prev_ts": own("_ts"), "contra_ts": contra("_ts"),
    }).drop("_price0", "_price1", "_ts0", "_ts1")


def wallet_state(tape: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """Net shares, last price and volumes per outcome of (market, wallet)."""
    tracks = [Track("w_trades", "sum", F.lit(1).cast("long")),
              Track("w_volume", "sum", F.col("notional_usdc")),
              Track("w_first_ts", "min", F.col("timestamp_ms")),
              Track("w_last_ts", "max", F.col("timestamp_ms"))]
    for o in (0, 1):
        here = F.col("outcome_index") == o
        tracks += [
            Track(f"w_shares{o}", "sum", F.when(here, signed_tokens()).otherwise(0.0)),
            Track(f"w_buy{o}", "sum", F.when(here & is_buy(), F.col("notional_usdc")).otherwise(0.0)),
            Track(f"w_sell{o}", "sum", F.when(here & ~is_buy(), F.col("notional_usdc")).otherwise(0.0)),
            Track(f"w_price{o}", "last", F.when(here, F.col("price")))]
    return running(tape, ["market_id", "wallet"], ORDER, tracks, chunk_ms)


def _pick(prefix: str) -> Column:
    return F.when(F.col("outcome_index") == 0, F.col(f"{prefix}0")).otherwise(F.col(f"{prefix}1"))


def wallet_ratios(df: DataFrame) -> DataFrame:
    """Exposure, directional ratios, concentration and hedge flag from wallet state."""
    exposure = sum(
        (F.abs(F.col(f"w_shares{o}") * F.coalesce(F.col(f"w_price{o}"), F.lit(0.0))) for o in (0, 1)),
        F.lit(0.0))
    vol = {o: F.col(f"w_buy{o}") + F.col(f"w_sell{o}") for o in (0, 1)}
    own_vol = F.when(F.col("outcome_index") == 0, vol[0]).otherwise(vol[1])
    own_exposure = F.abs(_pick("w_shares") * F.coalesce(_pick("w_price"), F.lit(0.0)))
    hedge_share = F.least(vol[0], vol[1]) / (vol[0] + vol[1])
    return df.withColumns({
        "net_exposure": exposure,
        "directional_ratio": F.when(F.col("w_volume") > 0, F.least(F.lit(1.0), exposure / F.col("w_volume")))
        .otherwise(0.0),
        "outcome_exposure": F.abs(_pick("w_shares") * F.coalesce(_pick("w_price"), F.col("price"))),
        "outcome_directional": F.when(own_vol >= 1e-6, F.least(F.lit(1.0), own_exposure / own_vol)).otherwise(0.0),
        "outcome_concentration": F.when(F.col("w_volume") >= 1e-6, F.least(F.lit(1.0), own_vol / F.col("w_volume")))
        .otherwise(0.0),
        "is_hedged": F.coalesce((vol[0] > 0) & (vol[1] > 0) & (hedge_share >= 0.3), F.lit(False)),
    })


def is_flipper(cfg: dict) -> Column:
    """Wallet with enough market volume but no direction (likely market maker)."""
    f = cfg["flipper_filter"]
    return ((F.col("w_volume") >= f["min_volume_for_pattern"])
            & (F.col("directional_ratio") < f["max_directional_ratio"]))


def position_summary(tape: DataFrame) -> DataFrame:
    """Final wallet state per (market, wallet): the ratios after the last trade."""
    last = F.max_by("price", F.struct(*ORDER))
    cols = [F.count(F.lit(1)).alias("w_trades"), F.sum("notional_usdc").alias("w_volume"),
            F.min("timestamp_ms").alias("w_first_ts"), F.max("timestamp_ms").alias("w_last_ts")]
    for o in (0, 1):
        here = F.col("outcome_index") == o
        cols += [
            F.sum(F.when(here, signed_tokens()).otherwise(0.0)).alias(f"w_shares{o}"),
            F.sum(F.when(here & is_buy(), F.col("notional_usdc")).otherwise(0.0)).alias(f"w_buy{o}"),
            F.sum(F.when(here & ~is_buy(), F.col("notional_usdc")).otherwise(0.0)).alias(f"w_sell{o}"),
            F.max_by("price", F.when(here, F.struct(*ORDER))).alias(f"w_price{o}")]
    agg = tape.groupBy("market_id", "wallet").agg(*cols, last.alias("price"))
    rated = wallet_ratios(agg.withColumn("outcome_index", F.lit(0)))
    return rated.drop("outcome_index", "price", "outcome_exposure", "outcome_directional", "outcome_concentration")


def _baseline_columns(n: Column, s: Column, q: Column) -> dict[str, Column]:
    var = (q - s * s / n) / (n - 1)
    return {"base_n": n, "base_mean": F.when(n > 0, s / n),
            "base_std": F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))}


def rolling_stats(state: DataFrame, source: DataFrame, window_ms: int = DAY_MS, chunk_ms: int = DAY_MS) -> DataFrame:
    """Count, mean and sample std of notional over the market's trailing window.

    The window is the one that ended at the market's previous trade: rows with
    ``ts >= previous ts - window``.  ``state`` comes from :func:`market_state`,
    ``source`` is the raw tape.  Adds base_n, base_mean, base_std.
    """
    x = F.col("notional_usdc")
    gone = departed_sums(state, source, ["market_id"], ORDER, [
        Track("_gn", "sum", F.lit(1).cast("long")), Track("_gs", "sum", x), Track("_gq", "sum", x * x)],
        "market_prev_ts", window_ms, chunk_ms)

    def alive(total: str, left: str) -> Column:
        return F.col(total) - F.coalesce(F.col(left), F.lit(0))

    cols = _baseline_columns(alive("market_trades_before", "_gn"), alive("_sum_x", "_gs"), alive("_sum_xx", "_gq"))
    return gone.withColumns(cols).drop("_gn", "_gs", "_gq")


def with_baseline(state: DataFrame, source: DataFrame, cfg: dict, chunk_ms: int = DAY_MS) -> DataFrame:
    """Volume baseline for the detector, including its restart rule.

    With a 24 h look-back the statistics run from the first trade on.  Any other
    look-back takes effect at the market's first qualifying trade, and only
    trades from there on count.
    """
    d = cfg["volume_anomaly"]
    hours = int(d["lookback_window_hours"])
    if hours == 24:
        return rolling_stats(state, source, DAY_MS, chunk_ms)
    qualifies = (F.col("notional_usdc") >= d["min_absolute_notional"]) & ~is_flipper(cfg)
    epoch = state.groupBy("market_id").agg(F.min(F.when(qualifies, F.struct(*ORDER))).alias("_epoch"))
    counted = F.struct(*ORDER) >= F.col("_epoch")
    since = source.join(epoch, "market_id").where(counted).drop("_epoch")
    x = F.col("notional_usdc")
    late = running(state.join(epoch, "market_id").withColumn("_x", F.when(counted, x)), ["market_id"], ORDER, [
        Track("_en", "sum", F.when(F.col("_x").isNotNull(), 1).otherwise(0).cast("long")),
        Track("_es", "sum", F.coalesce("_x", F.lit(0.0))),
        Track("_eq", "sum", F.coalesce(F.col("_x") * F.col("_x"), F.lit(0.0))),
        Track("_ets", "max", F.when(F.col("_x").isNotNull(), F.col("timestamp_ms")))], chunk_ms)
    gone = departed_sums(late, since, ["market_id"], ORDER, [
        Track("_gn", "sum", F.lit(1).cast("long")), Track("_gs", "sum", x), Track("_gq", "sum", x * x)],
        "_ets", hours * HOUR_MS, chunk_ms)

    def alive(total: str, left: str) -> Column:
        return F.col(total) - F.coalesce(F.col(left), F.lit(0))

    cols = _baseline_columns(alive("_en", "_gn"), alive("_es", "_gs"), alive("_eq", "_gq"))
    return gone.withColumns(cols).select(*state.columns, *cols)


def gap_medians(tape: DataFrame, chunk_ms: int = DAY_MS, block_rows: int = GAP_BLOCK) -> DataFrame:
    """Median of the last 200 positive gaps of an outcome, at every gap row.

    Zero gaps are no samples, so only the first trade of each millisecond
    matters.  Windows run over fixed-size row blocks with a 199-row lead, so a
    busy outcome is spread over many tasks.
    """
    key = ["market_id", "outcome_index"]
    moments = tape.groupBy(*key, "timestamp_ms").agg(F.min("seq").alias("seq"))
    gaps = running(moments, key, ORDER, [
        Track("_before", "max", F.col("timestamp_ms")), Track("_rn", "sum", F.lit(1).cast("long"))], chunk_ms)
    gaps = gaps.where("_before is not null").withColumn("gap_ms", F.col("timestamp_ms") - F.col("_before"))
    blocks = row_blocks(gaps, block_rows, GAP_RING - 1)
    # few bytes but much work per row: keep AQE from packing the blocks into one task
    n = int(tape.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = blocks.repartition(n, *key, "_block")
    ring = Window.partitionBy(*key, "_block").orderBy(*ORDER).rowsBetween(-(GAP_RING - 1), 0)
    # sorting the ring beats percentile(), which rebuilds a hash map for every row
    sample, n = F.col("_ring"), F.size("_ring")
    middle = (F.get(sample, ((n - 1) / 2).cast("int")) + F.get(sample, (n / 2).cast("int"))) / 2.0
    return (blocks.withColumn("_ring", F.sort_array(F.collect_list("gap_ms").over(ring))).where("_own")
            .withColumn("gap_median", middle)
            .select(*key, *ORDER, "gap_ms", "gap_median",
                    F.least(F.col("_rn"), F.lit(GAP_RING)).cast("long").alias("gap_n")))


def contra_gaps(df: DataFrame, source: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """Attach the other outcome's gap median and sample count, as of the trade."""
    ring = F.struct(F.col("gap_median").alias("m"), F.col("gap_n").alias("n"))
    marks = gap_medians(source, chunk_ms).select(
        "market_id", F.col("outcome_index").alias("_mo"), *ORDER, F.lit(0).alias("_kind"), ring.alias("_ring"))
    # two readers (totals and events): one exchange, so the medians are computed once
    marks = marks.repartition("market_id", F.floor(F.col("timestamp_ms") / F.lit(chunk_ms)))
    both = df.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    seen_marks = source.select("market_id", *ORDER, F.lit(1).alias("_kind")).unionByName(marks, allowMissingColumns=True)
    tracks = [Track(f"_ring{o}", "last", F.when(F.col("_mo") == o, F.col("_ring"))) for o in (0, 1)]
    seen = running(both, ["market_id"], [*ORDER, "_kind"], tracks, chunk_ms, source=seen_marks).where("_kind = 1")
    other = F.when(F.col("outcome_index") == 0, F.col("_ring1")).when(F.col("outcome_index") == 1, F.col("_ring0"))
    return (seen.withColumn("_contra", other)
            .withColumns({"contra_gap_median": F.col("_contra.m"),
                          "contra_gap_n": F.coalesce(F.col("_contra.n"), F.lit(0).cast("long"))})
            .drop("_kind", "_mo", "_ring", "_ring0", "_ring1", "_contra"))


def prior_counts(tape: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """What is known of the wallet and the market just before each trade.

    Wallet counts run across markets; ``wallet_market_share`` is the part of the
    wallet's earlier notional that went into this market.
    """
    n = F.lit(1).cast("long")
    df = running(tape, ["wallet"], ORDER, [Track("wallet_prior_trades", "sum", n),
                                           Track("wallet_prior_notional", "sum", F.col("notional_usdc"))], chunk_ms)
    df = running(df, ["wallet", "market_id"], ORDER, [Track("_wm", "sum", F.col("notional_usdc"))], chunk_ms,
                 source=tape)
    df = running(df, ["market_id"], ORDER, [Track("market_prior_trades", "sum", n)], chunk_ms, source=tape)
    share = F.when(F.col("wallet_prior_notional") > 0, F.col("_wm") / F.col("wallet_prior_notional")).otherwise(0.0)
    return df.withColumn("wallet_market_share", share).drop("_wm")


def prior_zscores(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add each name: z of its value against the key's strictly earlier values (0 when n < 2).

    One scan over ranges of (keys, order) for all values.
    """
    named = {name: F.col(f"_z{i}") for i, name in enumerate(values)}
    n = F.col("_n")
    tracks = [Track("_n", "sum", F.lit(1).cast("long"))]
    for i, v in enumerate(named.values()):
        tracks += [Track(f"_s{i}", "sum", v), Track(f"_q{i}", "sum", v * v)]
    tracked = ranged(df.withColumns({f"_z{i}": value for i, value in enumerate(values.values())}), keys, order, tracks)

    def z(i: int, v: Column) -> Column:
        s, q = F.col(f"_s{i}"), F.col(f"_q{i}")
        std = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
        return F.when((n >= 2) & (std >= 1e-12), (v - s / n) / std).otherwise(0.0)

    helpers = [f"{p}{i}" for i in range(len(named)) for p in ("_z", "_s", "_q")]
    return tracked.withColumns({name: z(i, v) for i, (name, v) in enumerate(named.items())}).drop("_n", *helpers)
