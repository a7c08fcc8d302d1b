"""What cluster boosts changed: three replays, and cohorts of the wallets that they flag."""

from pyspark.sql import functions as F

from tapescope.config import make_config
from tapescope.plans import studies

CFG = make_config(alert_threshold=0.5, recidivism={"min_prior_flags": 99, "midpoint": 200.0})


def test_arms_differ_by_their_boosts_only(spark):
    base = spark.createDataFrame([(1, i, i * 1000, w, s) for i, (w, s) in enumerate((("a", 0.4), ("b", 0.4), ("c", 0.4), ("d", 0.6), ("e", 0.3)))],
                                 "market_id int, seq long, timestamp_ms long, wallet string, base_score double")
    rows = [(1, 0, 1.5, 1.0, True), (1, 1, 1.0, 1.5, False), (1, 2, 1.2, 1.2, False), (1, 3, 1.1, 1.0, False), (1, 4, 1.0, 1.0, False)]
    boosts = spark.createDataFrame([*rows, rows[0]], "market_id int, seq long, cluster_multiplier float, jump_multiplier float, has_common_ownership boolean")
    boosts = boosts.withColumn("multiplier", F.col("cluster_multiplier") * F.col("jump_multiplier"))
    arms = studies.cluster_arms(base, boosts, CFG).cache()
    got = {(r.arm, r.wallet): r.is_alert for r in arms.collect()}
    assert len(got) == arms.count() == 15
    assert {w for (a, w), alert in got.items() if a == "with" and alert} == set("abcd")
    assert {w for (a, w), alert in got.items() if a == "without" and alert} == set("bd")
    assert {w for (a, w), alert in got.items() if a == "only" and alert} == set("ad")
    truth = spark.createDataFrame([(1, w, 10.0, 0.1, False) for w in "abcde"], "market_id int, wallet string, net_pnl double, wallet_return double, is_insider boolean")
    effect = studies.cluster_effect(arms, truth)
    assert {r.wallet: (r.decisive, round(r.boost, 6), r.owned) for r in effect.collect()} == {
        "a": (True, 1.5, True), "b": (False, 1.0, False), "c": (True, 1.2, False), "d": (False, 1.1, False), "e": (False, 1.0, False)}
    held = {}
    for r in studies.wallet_cohorts(effect).collect():
        held.setdefault((r.section, r.cohort), set()).add(r.wallet)
    assert held == {
        ("flagged", "all"): set("abcd"), ("membership", "in cluster"): set("acd"), ("membership", "none"): {"b"},
        ("decisiveness", "decisive"): set("ac"), ("decisiveness", "anyway"): set("bd"),
        ("boost", "1.4-1.6"): {"a"}, ("boost", "1.0-1.2"): set("cd"), ("boost", "none"): {"b"},
        ("ownership", "owned"): {"a"}, ("ownership", "not owned"): set("cd"), ("ownership", "none"): {"b"},
        ("boost and ownership", "1.4-1.6, owned"): {"a"}, ("boost and ownership", "1.0-1.2, not owned"): set("cd"), ("boost and ownership", "none, none"): {"b"}}
