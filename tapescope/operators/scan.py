"""Running values over an order that has no time, or that all rows share.

:func:`tapescope.operators.running.running` cuts a key by time.  Where the order
is a score, or one order runs over all rows, the values of a chunk have no
natural width.  Here Spark deals the rows by ranges of (keys, order), sampled
from the data, so a task holds about its share whatever the values are, and ties
are told apart by the rest of the order:

1. the dealt rows are written with the number of their range, which fixes it;
2. one row of totals for each (key, range), and what earlier ranges carry over;
3. a local window inside each (key, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapescope.operators.running import Track, _combine, _over, _total
from tapescope.session import cut


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` written with ``_part``, the range of (keys, order) a row is in; ranges follow the order."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], tracks: Sequence[Track], inclusive: bool = False, parts: int | None = None) -> DataFrame:
    """Add one column per track: its value over the key's earlier rows in ``order``, a total order inside the key.

    Rows with a null in ``order`` come first, as in an ascending window.
    """
    keys, order = list(keys), list(order)
    values = {t.name: f"_v_{t.name}" for t in tracks}
    dealt = ranges(df.withColumns({values[t.name]: t.value for t in tracks}), keys, order, parts)
    cell = [*keys, "_part"]
    totals = dealt.groupBy(*cell).agg(*[_total(t.kind, F.col(values[t.name]), order).alias(f"_t_{t.name}") for t in tracks])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*cell, *[_over(t.kind, F.col(f"_t_{t.name}"), before).alias(f"_c_{t.name}") for t in tracks])
    within = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = dealt.join(carry, cell).select("*", *[_over(t.kind, F.col(values[t.name]), within).alias(f"_l_{t.name}") for t in tracks])
    out = out.select("*", *[_combine(t.kind, F.col(f"_l_{t.name}"), F.col(f"_c_{t.name}")).alias(t.name) for t in tracks])
    return out.drop("_part", *values.values(), *[f"{p}{t.name}" for t in tracks for p in ("_l_", "_c_")])
