"""Exact quantiles of large groups.

``percentile`` keeps every distinct value of a group in one hash map, which a
hot group cannot afford.  Here a bounded sketch per group brackets the wanted
ranks, one counting pass places the bracket, and only the values inside it
(a few in 100,000 of a large group) are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000
SMALL = 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, Column],
                    probs: Sequence[float] = (0.5,)) -> DataFrame:
    """Rows (keys, metric, prob, quantile, n), linear interpolation, exact.

    Nulls are not counted; a metric without values gives no row.
    """
    keys = list(keys)
    long = (df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])).alias("_m"))
        .select(*keys, "_m.metric", "_m.value").where("value is not null"))
    group = [*keys, "metric"]
    slack = 3.0 / ACCURACY
    marks = [x for p in probs for x in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", marks, ACCURACY).alias("_q"))
    brackets = sketch.select(*group, "n", F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"),
                 F.when(F.col("n") > SMALL, F.get("_q", F.lit(2 * i))).alias("lo"),
                 F.when(F.col("n") > SMALL, F.get("_q", F.lit(2 * i + 1))).alias("hi"))
        for i, p in enumerate(probs)])).alias("_b")).select(*group, "n", "_b.*")
    # below the bracket: only counted; inside: one row per distinct value; above: dropped
    inside = (F.col("lo").isNull() | (F.col("value") >= F.col("lo")))
    placed = (long.join(brackets, group).where(F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
              .withColumn("_value", F.when(inside, F.col("value")))
              .groupBy(*group, "prob", "n", "_value").agg(F.count(F.lit(1)).alias("_c")))
    order = Window.partitionBy(*group, "prob").orderBy(F.col("_value").asc_nulls_first())
    ranked = placed.withColumn("_upto", F.sum("_c").over(order))
    h = (F.col("n") - 1) * F.col("prob")
    k0, k1 = F.floor(h), F.ceil(h)
    first = F.col("_upto") - F.col("_c")

    def at(k: Column) -> Column:
        return F.max(F.when((first <= k) & (k < F.col("_upto")), F.col("_value")))

    picked = ranked.groupBy(*group, "prob", "n").agg(at(k0).alias("_a"), at(k1).alias("_b"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (h - k0)
    return picked.select(*group, "prob", value.alias("quantile"), "n")


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys, one column per value): exact medians, null where a group has none."""
    keys = list(keys)
    q = exact_quantiles(df, keys, values)
    return q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == n, F.col("quantile"))).alias(n) for n in values])


def join_medians(aggregate: DataFrame, df: DataFrame, keys: Sequence[str], values: dict[str, Column],
                 default: float | None = None) -> DataFrame:
    """Add median columns to an aggregate of ``df`` over the same keys."""
    keys = list(keys)
    if keys:
        out = aggregate.join(medians(df, keys, values), keys, "left")
    else:
        out = aggregate.join(medians(df, keys, values), F.lit(True), "left")
    return out if default is None else out.fillna(default, list(values))
