"""Published detection baselines on the same tape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapescope.functions.stats import div
from tapescope.operators import economics, markets, state
from tapescope.operators.jumps import largest_price_jump
from tapescope.operators.running import HOUR_MS, Track, running
from tapescope.operators.scan import ranged
from tapescope.operators.state import ORDER, is_buy, signed_tokens
from tapescope.session import cut


def timing_heuristic(tape: DataFrame, close: DataFrame, max_prior: int, min_notional: float, max_hours: float) -> DataFrame:
    """Large BUY of a wallet with little history, shortly before resolution."""
    counted = running(tape, ["market_id", "wallet"], ORDER, [Track("_here", "sum", F.lit(1).cast("long"))])
    seeded = counted.join(markets.prior_trade_counts(tape), ["market_id", "wallet"]).join(close, "market_id")
    left = F.col("close_ms") - F.col("timestamp_ms")
    return seeded.where((F.col("_here") + F.col("prior_trades") <= max_prior) & is_buy() & (F.col("notional_usdc") >= min_notional)
                        & left.between(0, int(max_hours * HOUR_MS))).select("market_id", "seq", "wallet", "timestamp_ms")


def wallet_pairs(tape: DataFrame, winners: DataFrame, min_notional: float = 500.0) -> DataFrame:
    """(wallet, market) pairs over their BUY trades."""
    buys = tape.where(is_buy()).join(winners, "market_id")
    won = F.col("outcome_index") == F.col("winner")
    by = [F.sum(F.when(F.col("outcome_index") == o, F.col("notional_usdc")).otherwise(0.0)).alias(f"_n{o}") for o in (0, 1)]
    return buys.groupBy("market_id", "wallet").agg(
        F.sum("notional_usdc").alias("bn"), F.sum(F.when(won, F.col("size_tokens")).otherwise(0.0)).alias("win_tokens"),
        F.count(F.lit(1)).alias("n_buys"), *by).where(F.col("bn") >= min_notional)


def _population_z(df: DataFrame, columns: list[str]) -> DataFrame:
    s = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = {f"z_{c}": F.when(F.col(f"_s_{c}") >= 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.crossJoin(F.broadcast(s)).withColumns(z).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def size_profit_screen(tape: DataFrame, winners: DataFrame, min_notional: float = 500.0) -> DataFrame:
    """Retrospective five-signal composite per (wallet, market) pair."""
    pairs = wallet_pairs(tape, winners, min_notional)
    jump = largest_price_jump(tape, winners).select("market_id", "jump_ts")
    early = (tape.where(is_buy()).join(jump, "market_id").where("timestamp_ms < jump_ts")
             .groupBy("market_id", "wallet").agg(F.sum("notional_usdc").alias("_early")))
    own = pairs.groupBy("wallet").agg(F.avg("bn").alias("_wm"), F.stddev_samp("bn").alias("_ws"), F.count(F.lit(1)).alias("_wn"))
    df = pairs.join(early, ["market_id", "wallet"], "left").join(own, "wallet").withColumns({
        "s1": F.log1p("bn"),
        "s2": F.when((F.col("_wn") >= 2) & (F.col("_ws") >= 1e-12), (F.col("bn") - F.col("_wm")) / F.col("_ws")).otherwise(0.0),
        "s3": (F.col("win_tokens") - F.col("bn")) / F.col("bn"),
        "s4": F.coalesce("_early", F.lit(0.0)) / F.col("bn"),
        "s5": F.greatest("_n0", "_n1") / F.col("bn")})
    z = _population_z(df, ["s1", "s2", "s3", "s4", "s5"])
    total = sum((F.col(f"z_s{i}") for i in range(1, 6)), F.lit(0.0))
    return z.select("market_id", "wallet", "bn", "n_buys", total.alias("composite"))


def size_timing_screen(tape: DataFrame, winners: DataFrame, close: DataFrame, low_price: float = 0.3, min_notional: float = 500.0) -> DataFrame:
    """Causal four-signal composite: each pair against strictly earlier pairs only."""
    rows = tape.where(is_buy()).join(winners, "market_id").join(close, "market_id").where("timestamp_ms < close_ms")
    w = F.col("notional_usdc")
    by = [F.sum(F.when(F.col("outcome_index") == o, w).otherwise(0.0)).alias(f"_n{o}") for o in (0, 1)]
    pairs = rows.groupBy("market_id", "wallet").agg(
        F.sum(w).alias("bn"), F.max("timestamp_ms").alias("cutoff"), F.count(F.lit(1)).alias("n_buys"),
        F.sum(F.when(F.col("price") <= low_price, w).otherwise(0.0)).alias("_low"),
        F.sum((F.col("close_ms") - F.col("timestamp_ms")) / float(HOUR_MS) * w).alias("_hours"), *by).where(F.col("bn") >= min_notional)
    df = pairs.withColumns({
        "s1": F.log1p("bn"), "s4": F.col("_low") / F.col("bn") * F.greatest(F.col("_hours") / F.col("bn"), F.lit(0.0)),
        "s5": F.greatest("_n0", "_n1") / F.col("bn")}).drop("_low", "_hours", "_n0", "_n1")
    order = ["cutoff", "market_id", "wallet"]
    df = state.prior_zscores(df, [], order, {f"z_{c}": F.col(c) for c in ("s1", "s4", "s5")})
    df = state.prior_zscores(df, ["wallet"], order, {"z_s2": F.col("bn")})
    return df.select("market_id", "wallet", "bn", "n_buys", "cutoff", (F.col("z_s1") + F.col("z_s2") + F.col("z_s4") + F.col("z_s5")).alias("composite"))


def select_until_target(pairs: DataFrame, target: Column | float) -> DataFrame:
    """Highest composites until their BUY trades reach the target."""
    down = pairs.withColumn("_o", -F.col("composite"))
    cum = ranged(down, [], ["_o", "market_id", "wallet"], [Track("_taken", "sum", F.col("n_buys"))])
    return cum.where(F.col("_taken") < target).drop("_o", "_taken")


def select_top_percent(pairs: DataFrame, percent: float) -> DataFrame:
    n = pairs.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * (percent / 100.0))).alias("_k"))
    down = pairs.withColumn("_o", -F.col("composite"))
    ranked = ranged(down, [], ["_o", "market_id", "wallet"], [Track("_above", "sum", F.lit(1).cast("long"))])
    return ranked.crossJoin(F.broadcast(n)).where(F.col("_above") < F.col("_k")).drop("_o", "_above", "_k")


def trajectories(tape: DataFrame, winners: DataFrame, bucket_hours: int = 6, min_notional: float = 500.0) -> DataFrame:
    """(market_id, wallet, x, d_active): position path on the market's bucket grid, scaled to 1.

    Per (market, wallet) at most one row per bucket reaches the array, so it is
    bounded by the market's life over the bucket width.
    """
    width = bucket_hours * HOUR_MS
    rows = tape.join(winners, "market_id").withColumn("b", F.floor(F.col("timestamp_ms") / width))
    grid = rows.groupBy("market_id").agg(F.min("b").alias("b0"), F.max("b").alias("b1")).where("b1 > b0")
    able = rows.groupBy("market_id", "wallet").agg(F.sum("notional_usdc").alias("_n")).where(F.col("_n") >= min_notional)
    delta = (rows.where("outcome_index = winner").groupBy("market_id", "wallet", "b").agg(F.sum(signed_tokens()).alias("d"))
             .join(able, ["market_id", "wallet"], "left_semi"))
    sparse = delta.groupBy("market_id", "wallet").agg(F.map_from_entries(F.collect_list(F.struct("b", "d"))).alias("_d"),
                                                      F.count_if(F.abs("d") > 1e-12).alias("d_active"))
    dense = sparse.join(grid, "market_id")
    steps = F.transform(F.sequence("b0", "b1"), lambda b: F.coalesce(F.try_element_at("_d", b), F.lit(0.0)))
    path = F.aggregate(steps, F.array().cast("array<double>"), lambda acc, d: F.concat(acc, F.array(
        F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + d)))
    out = dense.withColumn("_x", path).withColumn("_m", F.array_max(F.transform("_x", lambda v: F.abs(v)))).where("_m >= 1e-12")
    scaled = out.select("market_id", "wallet", "d_active", "b0", F.transform("_x", lambda v: v / F.col("_m")).alias("x"))
    enough = scaled.groupBy("market_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return scaled.join(enough, "market_id", "left_semi")


def pca_error(paths: DataFrame, n_components: int = 3) -> DataFrame:
    """Add s_star (largest reconstruction error of a path) and b_star (its bucket).

    Tasks sum outer products of their own rows, one T x T matrix per market; the
    few partial matrices of a market meet in one row where the eigenvectors are
    found; each path is then projected by a vectorised function.
    """
    gram_schema = "market_id int, n long, s array<double>, g array<double>"

    def partial(batches):
        acc: dict[int, list] = {}
        for pdf in batches:
            for m, part in pdf.groupby("market_id"):
                x = np.vstack(part["x"].to_list())
                if m in acc:
                    a = acc[m]
                    a[0] += len(x); a[1] += x.sum(0); a[2] += x.T @ x
                else:
                    acc[m] = [len(x), x.sum(0), x.T @ x]
        yield pd.DataFrame([(m, a[0], a[1], a[2].ravel()) for m, a in acc.items()], columns=["market_id", "n", "s", "g"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = int(pdf["n"].sum()), np.sum(np.vstack(pdf["s"].to_list()), axis=0)
        t = len(s)
        g = np.sum(np.vstack(pdf["g"].to_list()), axis=0).reshape(t, t)
        k = min(n_components, n - 1, t - 1)
        mean = s / n
        vals, vecs = np.linalg.eigh(g - n * np.outer(mean, mean))
        top = vecs[:, np.argsort(vals)[::-1][:max(k, 1)]]
        return pd.DataFrame([(pdf["market_id"].iloc[0], mean, top.ravel(), k)], columns=["market_id", "mean", "axes", "k"])

    sums = paths.select("market_id", "x").mapInPandas(partial, gram_schema)
    axes = sums.groupBy("market_id").applyInPandas(solve, "market_id int, mean array<double>, axes array<double>, k int")

    @F.pandas_udf("array<double>")
    def residual(x: pd.Series, mean: pd.Series, axes: pd.Series) -> pd.Series:
        out = []
        for a, m, v in zip(x, mean, axes):
            c, m = np.asarray(a) - np.asarray(m), np.asarray(m)
            v = np.asarray(v).reshape(len(c), -1)
            out.append(np.abs(c - v @ (v.T @ c)))
        return pd.Series(out)

    e = paths.join(axes, "market_id").withColumn("_e", residual("x", "mean", "axes"))
    s = F.array_max("_e")
    return e.select("market_id", "wallet", "x", "d_active", "b0", "k", s.alias("s_star"), (F.array_position("_e", s) - 1).cast("int").alias("b_star"))


def bimodal_trough(scores: DataFrame, value: str = "s_star", min_wallets: int = 8, percentile: float = 0.9, points: int = 256) -> DataFrame:
    """(market_id, eps, rule): density trough between the two top modes, else a percentile."""
    from tapescope.operators.quantiles import exact_quantiles
    v = F.col(value)
    s = scores.groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    fall = exact_quantiles(scores, ["market_id"], {"v": v}, (percentile,)).select("market_id", F.col("quantile").alias("_pct"))
    able = s.where((F.col("n") >= min_wallets) & (F.col("hi") - F.col("lo") >= 1e-12))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = able.select("market_id", "n", h.alias("h"), "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn(
        "at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / float(points - 1))
    dens = scores.select("market_id", v.alias("_v")).join(grid, "market_id").groupBy("market_id", "i", "at").agg(
        F.sum(F.exp(-0.5 * F.pow((F.col("at") - F.col("_v")) / F.col("h"), F.lit(2.0)))).alias("d"))
    w = Window.partitionBy("market_id").orderBy("i")  # ``points`` rows per market
    peaks = dens.withColumn("_peak", (F.col("d") > F.lag("d").over(w)) & (F.col("d") > F.lead("d").over(w)))
    top = peaks.where("_peak").withColumn("_r", F.row_number().over(Window.partitionBy("market_id").orderBy(F.desc("d"), "i"))).where("_r <= 2")
    ends = top.groupBy("market_id").agg(F.min("i").alias("_a"), F.max("i").alias("_b"), F.count(F.lit(1)).alias("_k")).where("_k = 2")
    trough = dens.join(ends, "market_id").where(F.col("i").between(F.col("_a"), F.col("_b"))).groupBy("market_id").agg(
        F.min_by("at", F.struct("d", "i")).alias("_trough"))
    return s.select("market_id").join(fall, "market_id").join(trough, "market_id", "left").select(
        "market_id", F.coalesce("_trough", "_pct").alias("eps"), F.when(F.col("_trough").isNotNull(), "bimodal_trough").otherwise("percentile_fallback").alias("rule"))


def trajectory_screen(tape: DataFrame, winners: DataFrame, close: DataFrame, bucket_hours: int = 6, investigation_hours: int = 24,
                      d_theta: int = 3, n_components: int = 3, min_notional: float = 500.0) -> DataFrame:
    """Wallets whose position path stands out near the price-sensitive event."""
    width = bucket_hours * HOUR_MS
    paths = cut(trajectories(tape, winners, bucket_hours, min_notional))
    err = cut(pca_error(paths, n_components))
    eps = bimodal_trough(err)
    span = tape.groupBy("market_id").agg(F.min("timestamp_ms").alias("_t0"), F.max("timestamp_ms").alias("_t1"))
    jump = largest_price_jump(tape, winners, positive_only=True).select("market_id", "jump_ts")
    anchor = span.join(jump, "market_id", "left").join(close, "market_id", "left")
    t = F.size("x")
    at = F.floor(F.coalesce("jump_ts", "close_ms") / width) - F.col("b0")
    counts = err.groupBy("market_id", "b_star").agg(F.count(F.lit(1)).alias("n_b"))
    size = err.select("market_id", t.alias("_T")).distinct()
    per = size.join(counts, "market_id").groupBy("market_id", "_T").agg(F.collect_list("n_b").alias("_c"))  # at most T numbers
    filled = F.sort_array(F.concat("_c", F.transform(F.sequence(F.lit(1), F.col("_T") - F.size("_c") + 1), lambda i: F.lit(0).cast("long"))))
    arr = F.slice(filled, 2, F.col("_T"))
    pos = (F.col("_T") - 1) * 0.9
    lo, hi = F.get(F.col("_a"), F.floor(pos).cast("int")), F.get(F.col("_a"), F.ceil(pos).cast("int"))
    limits = per.withColumn("_a", arr).select("market_id", (lo + (hi - lo) * (pos - F.floor(pos))).alias("n_theta"))
    df = (err.join(counts, ["market_id", "b_star"]).join(eps, "market_id").join(limits, "market_id")
          .join(anchor, "market_id").withColumn("pse", F.greatest(F.lit(0), F.least(t - 1, at))))
    inv = F.when(F.col("_t1") - F.col("_t0") < 48 * HOUR_MS, F.greatest(F.lit(1), F.ceil(t * 0.5))).otherwise(max(1, round(investigation_hours / bucket_hours)))
    df = df.withColumn("start", F.greatest(F.lit(0).cast("long"), F.col("pse") - inv + 1)).where("start >= 2")
    hit = ((F.col("s_star") >= F.col("eps")) & F.col("b_star").between(F.col("start"), F.col("pse"))
           & ((F.col("d_active") <= d_theta) | (F.col("n_b") < F.col("n_theta")))
           & (F.get("x", F.col("pse").cast("int")) - F.get("x", F.lit(0)) > 0.5))
    return df.select("market_id", "wallet", "s_star", "b_star", "d_active", "n_b", "eps", "rule", hit.alias("is_flagged"))


FEATURES = ["log_notional", "price", "is_buy", "wallet_prior_trades", "wallet_prior_notional", "wallet_market_share", "hours_to_close",
            "outcome", "market_prior_trades"]


def anomaly_features(tape: DataFrame, close: DataFrame) -> DataFrame:
    """Nine features per trade, all known before the trade."""
    df = state.prior_counts(tape).join(close, "market_id", "left")
    return df.withColumns({
        "log_notional": F.log(F.col("notional_usdc") + 1.0), "is_buy": is_buy().cast("double"),
        "hours_to_close": F.coalesce((F.col("close_ms") - F.col("timestamp_ms")) / float(HOUR_MS), F.lit(0.0)),
        "outcome": F.col("outcome_index").cast("double")}).select(
        "seq", "market_id", "wallet", "timestamp_ms", "side", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def _avg_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as (feature, cut, left, right, path length) rows."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(())
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[me] = (-1, 0.0, 0, 0, depth + _avg_path(len(rows)))
            return me
        f = int(rng.choice(usable))
        at = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] <= at
        a, b = build(rows[left], depth + 1), build(rows[~left], depth + 1)
        nodes[me] = (f, at, a, b, 0.0)
        return me

    build(x, 0)
    return nodes


def isolation_forest(features: DataFrame, n_trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Add ``anomaly`` (negative: stands out) from a forest of small random trees.

    Every tree sees at most ``sample`` rows picked by hash; trees are grown as
    one group each.  The forest (trees x 2 * sample nodes at most, so of fixed
    size) goes to all tasks, which score trades in batches.
    """
    spark = features.sparkSession
    n = max(features.count(), 1)
    keep = min(1.0, 4.0 * sample / n)
    trees = spark.range(n_trees).select(F.col("id").cast("int").alias("tree"))
    u = F.pmod(F.xxhash64("seq", "tree", F.lit(seed)), F.lit(1_000_003))
    picked = features.crossJoin(F.broadcast(trees)).withColumn("_u", u).where(F.col("_u") < keep * 1_000_003)
    picked = markets.top_k(picked.select("tree", "_u", "seq", *FEATURES), ["tree"], [F.asc("_u"), F.asc("seq")], sample)
    limit = int(np.ceil(np.log2(sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("seq")[FEATURES].to_numpy(float)
        rows = _grow(x, np.random.default_rng(seed + t), limit)
        return pd.DataFrame([(t, i, *r) for i, r in enumerate(rows)], columns=["tree", "node", "f", "cut", "l", "r", "path"])

    table = picked.groupBy("tree").applyInPandas(grow, "tree int, node int, f int, cut double, l int, r int, path double").toPandas()
    forest = spark.sparkContext.broadcast([g.sort_values("node")[["f", "cut", "l", "r", "path"]].to_numpy(float) for _, g in table.groupby("tree")])
    norm = _avg_path(min(sample, n))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for t in forest.value:
            at = np.zeros(len(x), dtype=int)
            for _ in range(limit + 1):
                f = t[at, 0].astype(int)
                inner = f >= 0
                go_left = x[np.arange(len(x)), np.where(inner, f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go_left, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 4]
        return pd.Series(0.5 - np.power(2.0, -(total / max(len(forest.value), 1)) / norm))

    return features.withColumn("anomaly", score(*FEATURES))


def matched_threshold(scores: DataFrame, rate: float, order: str = "anomaly") -> DataFrame:
    """One row: the k-th smallest BUY score, k = round(rate * n), at least 1."""
    buys = scores.where(is_buy()).select(F.col(order).alias("_s"), "seq")
    k = buys.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * rate)).alias("_k"))
    ranked = ranged(buys, [], ["_s", "seq"], [Track("_rank", "sum", F.lit(1).cast("long"))], inclusive=True)
    return ranked.crossJoin(F.broadcast(k)).where("_rank = _k").select(F.col("_s").alias("threshold"))


def random_baseline(buys: DataFrame, rate: float, n_trials: int = 5) -> DataFrame:
    """Per trial: metrics of random flags.  The draw is an integer hash of (seq, trial)
    that any SQL engine can repeat."""
    spark = buys.sparkSession
    trials = F.broadcast(spark.range(n_trials).withColumnRenamed("id", "trial"))
    draw = F.pmod(F.col("seq") * 7919 + (F.col("trial") + 1) * 104_729 + F.pmod(F.col("seq"), F.lit(1009)) * F.pmod(F.col("seq"), F.lit(1013)) * 31, F.lit(10_007))
    rows = buys.drop("is_flagged").crossJoin(trials).withColumn("is_flagged", draw < int(rate * 10_007))
    agg = economics.two_sided(rows, ["trial"])
    from tapescope.functions import stats
    d = stats.pooled_d(F.col("f_n"), F.col("f_mean"), F.col("f_var"), F.col("u_n"), F.col("u_mean"), F.col("u_var"))
    return agg.select("trial", F.col("f_n").alias("flagged"), F.col("u_n").alias("unflagged"), (F.col("f_mean") - F.col("u_mean")).alias("mean_return_diff"),
                      d.alias("cohens_d"), div(F.col("f_wx"), F.col("f_w")).alias("roi"))


def flag_state(flagged: DataFrame, tape: DataFrame, method: str, threshold: float = 0.5) -> DataFrame:
    """Per (market, wallet): flags of a method (rows of market_id, wallet) and its class."""
    n = flagged.groupBy("market_id", "wallet").agg(F.count(F.lit(1)).alias("num_flags"))
    t = tape.groupBy("market_id", "wallet").agg(F.count(F.lit(1)).alias("trade_count"))
    return n.join(t, ["market_id", "wallet"]).select(
        F.lit(method).alias("method"), "market_id", "wallet", "num_flags", (F.col("num_flags") > 0).alias("any_flag"),
        (F.col("num_flags") / F.col("trade_count") >= threshold).alias("classified"))


def baseline_metrics(buys: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for any flag set: trade economics and wallet tp/fp/fn."""
    trade = economics.two_sided(buys, []).select(
        F.col("f_n").alias("flagged_trades"), F.col("u_n").alias("unflagged_trades"), (F.col("f_mean") - F.col("u_mean")).alias("mean_return_diff"),
        div(F.col("f_wx"), F.col("f_w")).alias("copytrade_roi"))
    wallets = buys.where("is_flagged").select("market_id", "wallet").distinct().withColumn("_f", F.lit(True))
    df = truth.join(wallets, ["market_id", "wallet"], "left")
    y, f = F.col("is_insider"), F.coalesce("_f", F.lit(False))
    conf = df.agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"))
    return trade.crossJoin(conf)


def method_comparison(states: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per method with precision, recall and F-scores of its classified wallets."""
    from tapescope.operators.evaluation import with_fscores
    from tapescope.operators.sweeps import label_recall
    r = label_recall(states, truth)
    return with_fscores(r.select("method", F.col("classified_tp").alias("tp"), F.col("classified_fp").alias("fp"), F.col("classified_fn").alias("fn"), "flag_volume"))
