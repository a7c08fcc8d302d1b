"""Whole studies, composed from the operators."""

from pyspark.sql import functions as F

from tapescope.operators import baselines, causal, graph, jumps, labels, markets, scoring, search, sweeps
from tapescope.operators.iterate import union_all
from tapescope.operators.running import DAY_MS
from tapescope.plans.base import CFG, FLAG_RATE, frozen, rnd, tape, truth, winners
from tapescope.plans.baselines import close, timing
from tapescope.plans.evaluate import rounded
from tapescope.plans.registry import query
from tapescope.plans.sweeps import DETS, SEARCH_RATE, TRIED
from tapescope.session import cut
from tapescope.sources import tables

def part_of(spark, sf, split):
    """(rows of a frame whose market is in a part) for the parts of a split of the markets."""
    parts = cut(split.select("market_id", "part"))
    return lambda df, name: df.join(parts.where(F.col("part") == name).select("market_id"), "market_id", "left_semi")


def tested(rows, wallets, cfg):
    """The metrics of one setting."""
    return search.evaluated(rows, wallets, "alert_threshold", {"value": [cfg["alert_threshold"]]}, cfg, SEARCH_RATE).drop("p_value")


@query("train_test_full_market")
def _(spark, sf):
    """Settings from the older markets, tested on the newest 30%, whole histories."""
    t, wallets = tape(spark, sf), cut(truth(spark, sf))
    of = part_of(spark, sf, markets.split_by_close_time(tables.markets(spark, sf), 0.3))
    cfg, _best, _log = search.descend(of(t, "train"), search.states(of(t, "train"), CFG), of(wallets, "train"), CFG, TRIED, SEARCH_RATE)
    return rounded(tested(search.states(of(t, "eval"), cfg), of(wallets, "eval"), cfg), 5)


@query("alternating_search")
def _(spark, sf):
    """Descents from two starts; the validation markets pick one."""
    t, wallets = tape(spark, sf), cut(truth(spark, sf))
    of = part_of(spark, sf, markets.train_val_split(tables.markets(spark, sf), 0.4))
    rows = []
    for i, start in enumerate((CFG, search.with_setting(CFG, "alert_threshold", {"value": 0.3}))):
        cfg, score, _log = search.descend(of(t, "train"), search.states(of(t, "train"), start), of(wallets, "train"), start, TRIED, SEARCH_RATE)
        check = tested(search.states(of(t, "val"), cfg), of(wallets, "val"), cfg).first()
        rows.append((i, float(score), float(check["f1"])))
    runs = spark.createDataFrame(rows, "start_id long, train_score double, val_score double")
    return rounded(sweeps.multi_start_summary(runs), 5)


@query("boosts_for_markets")
def _(spark, sf):
    """Final wallet boosts of every market: clusters over its whole history times jumps."""
    t = tape(spark, sf)
    member, meta = graph.clusters(graph.large_trades(t, CFG), CFG, transfers=tables.transfers(spark, sf))
    rows = t.select("market_id", "wallet").distinct()
    boosts = graph.apply_wallet_boosts(rows, graph.wallet_boosts(member, meta).select("market_id", "wallet", "boost", "has_common_ownership"))
    scores = jumps.score_jump_wallets(t, jumps.find_jumps(t, CFG), CFG)
    return jumps.apply_jump_boost(boosts, scores).select("market_id", "wallet", *rnd("boost"), "has_common_ownership")


@query("compare_methods")
def _(spark, sf):
    """The full system next to the baselines on the same tape and labels."""
    t, win, s = tape(spark, sf), winners(spark, sf), frozen(spark, sf)
    features = baselines.isolation_forest(baselines.anomaly_features(t, close(spark, sf)), 100)
    pairs = baselines.select_top_percent(baselines.size_profit_screen(t, win), 5.0).select("market_id", "wallet")
    buys = t.where("side = 'BUY'")
    flagged = {
        "system": s.where("is_alert"), "timing": timing(spark, sf), "forest": features.where("anomaly < 0"),
        "size_profit": buys.join(pairs, ["market_id", "wallet"], "left_semi"),
        "random": buys.where(F.pmod(F.xxhash64("seq"), F.lit(100)) < 10)}
    states = union_all([baselines.flag_state(f.select("market_id", "wallet"), t, m, FLAG_RATE) for m, f in flagged.items()])
    return rounded(baselines.method_comparison(cut(states), truth(spark, sf)), 5)


@query("run_ablation")
def _(spark, sf):
    """Wallet metrics of the full system and without each detector, on the later half."""
    s, t = frozen(spark, sf), truth(spark, sf)
    late = s.where(F.col("timestamp_ms") >= 1704067200000 + 15 * DAY_MS)
    rows = [(i, *[0.0 if d == off else 1.0 for d in DETS], 0.5, 0.5) for i, off in enumerate([None, *DETS])]
    grid = spark.createDataFrame(rows, "candidate long, " + ", ".join(f"w_{d} double" for d in DETS) + ", alert_threshold double, flag_rate double")
    names = spark.createDataFrame([(i, "full" if d is None else f"no_{d}") for i, d in enumerate([None, *DETS])], "candidate long, variant string")
    return rounded(sweeps.evaluate_candidates(late, t, grid, DETS).join(names, "candidate"), 5)


#: Edges of the classes of cluster boosts; a wallet in no cluster has a boost of 1.
BOOST_EDGES = (1.2, 1.4, 1.6, 1.8, 2.0)


def cluster_arms(base, boosts, cfg):
    """Replays with cluster and jump boosts, without clusters and with clusters only: the trades of ``base`` once for each arm, keyed by it."""
    kinds = {"with": "multiplier", "without": "jump_multiplier", "only": "cluster_multiplier"}
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(m).alias("multiplier")) for a, m in kinds.items()])
    marks = boosts.select("market_id", "seq", arms.alias("_arms"), F.col("cluster_multiplier").alias("boost"), "has_common_ownership").dropDuplicates(["market_id", "seq"])
    rows = base.join(marks, ["market_id", "seq"]).withColumn("_arm", F.explode("_arms")).select("*", "_arm.arm", "_arm.multiplier").drop("_arm", "_arms")
    return scoring.recidivism_replay(rows, cfg, ["arm", "market_id", "wallet"])


def cluster_effect(arms, truth):
    """Per labelled wallet: flags with and without clusters, and its largest cluster boost where clusters are all there is."""
    flags = lambda arm: arms.where(F.col("arm") == arm).groupBy("market_id", "wallet").agg(F.count_if("is_alert").alias("num_flags"))
    only = arms.where("arm = 'only'").groupBy("market_id", "wallet").agg(F.max(F.col("boost").cast("double")).alias("boost"), F.max("has_common_ownership").alias("owned"))
    change = sweeps.wallet_counterfactual(flags("with"), flags("without"))
    return truth.join(change, ["market_id", "wallet"]).join(only, ["market_id", "wallet"])


def wallet_cohorts(rows):
    """Wallets that are flagged with clusters, by membership, decisiveness, boost, ownership, and boost and ownership; and those no longer flagged."""
    inside = F.col("boost") > 1.0 + 1e-6
    label = F.lit("none")
    for low, high in reversed(list(zip((1.0, *BOOST_EDGES), BOOST_EDGES))):
        last = high == BOOST_EDGES[-1]
        label = F.when(inside & (F.lit(True) if last else F.col("boost") <= high + 1e-6), F.lit(f"{low}-{high}")).otherwise(label)
    owned = F.when(F.col("owned"), "owned").when(inside, "not owned").otherwise("none")
    flagged = F.col("flags_with") > 0
    cohorts = F.array(*[F.struct(F.lit(s).alias("section"), F.when(on, c).alias("cohort")) for s, c, on in (
        ("flagged", F.lit("all"), flagged), ("membership", F.when(inside, "in cluster").otherwise("none"), flagged),
        ("decisiveness", F.when(F.col("decisive"), "decisive").otherwise("anyway"), flagged), ("boost", label, flagged),
        ("ownership", owned, flagged), ("boost and ownership", F.concat_ws(", ", label, owned), flagged), ("flagged", F.lit("suppressed"), F.col("suppressed")))])
    return rows.withColumn("_c", F.explode(cohorts)).select("*", "_c.section", "_c.cohort").drop("_c").where("cohort is not null")


@query("run_cluster_effectiveness")
def _(spark, sf):
    """What the causal cluster boosts changed: replays with clusters and jumps, with jumps only and with clusters only; wallets, BUY trades, wallets behind boosted trades, clusters."""
    t, win, wallets = tape(spark, sf), winners(spark, sf), cut(truth(spark, sf))
    boosts = causal.boost_schedule(t, CFG, tables.transfers(spark, sf))
    arms = cut(cluster_arms(frozen(spark, sf), boosts, CFG))
    of = lambda rows, section: rows.withColumn("section", F.lit(section))
    effect = cut(cluster_effect(arms, wallets))
    every = sweeps.cohort_economics(effect, ["decisive", "owned"])
    economics = sweeps.cohort_economics(wallet_cohorts(effect), ["section", "cohort"]).where("section is not null and cohort is not null")
    hits = arms.groupBy("market_id", "seq").agg(F.max(F.when(F.col("arm") == "without", F.col("is_alert"))).alias("base_hit"),
                                                F.max(F.when(F.col("arm") == "with", F.col("is_alert"))).alias("boosted_hit"), F.max("boost").alias("multiplier"))
    hits = cut(hits)
    trades = sweeps.trade_counterfactual(labels.buy_returns(t, win).join(hits, ["market_id", "seq"]))
    behind = F.filter(F.array(F.when((F.col("multiplier") > 1) & F.col("boosted_hit") & ~F.col("base_hit"), "to alert"),
                              F.when((F.col("multiplier") > 1) & F.col("boosted_hit") & F.col("base_hit"), "anyway"), F.when(F.col("multiplier") > 1, "any trade"),
                              F.when((F.col("multiplier") <= 1) & F.col("boosted_hit"), "not boosted alert")), lambda x: x.isNotNull())
    pairs = t.join(hits, ["market_id", "seq"]).select("market_id", "wallet", F.explode(behind).alias("cohort")).distinct()
    boosted = sweeps.cohort_economics(wallets.join(pairs, ["market_id", "wallet"]), ["cohort"]).where("cohort is not null")
    member, _meta = graph.clusters(graph.large_trades(t, CFG), CFG)
    found = sweeps.cluster_returns(wallets, member).withColumn("cohort", F.concat_ws(":", F.col("market_id").cast("string"), "community")).drop("market_id", "community")
    parts = [of(every, "all wallets"), economics, of(trades.withColumnRenamed("pnl", "net_pnl"), "BUY trades"), of(boosted, "wallets of trades"), of(found, "clusters")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return rounded(out, 4)
