"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into blocks by hash.  From the block counts (a few numbers) an
exact matrix is drawn: how many rows of each block go to each shard, so that the
shards have the sizes asked for and every assignment is equally likely.  Rows are
permuted inside their block, the first ones go to shard 0, the next ones to
shard 1 and so on, and are permuted again inside their shard.  Block and shard
are split so that no window holds more than about ``BUCKET_ROWS`` rows.

Only DataFrame functions touch rows; the matrix is drawn from block totals on the
driver.  Row numbers are fixed by writing the rows once, so a retried task finds
the same permutation.

Defined cases: null and empty text have size 8 and the checksum of no bytes;
repeated rows are dealt each; an empty table gives no rows; input columns named
like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapescope.llm.common import written

BUCKET_ROWS = 1_000_000


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """One draw by inversion: successes in ``sample`` draws without replacement.

    Probabilities are summed over ten standard deviations around the mode,
    beyond which double precision holds nothing; any population size will do.
    """
    low, high = max(0, sample - bad), min(good, sample)
    total = good + bad
    if low >= high:
        return low
    mode = min(high, max(low, (good + 1) * (sample + 1) // (total + 2)))
    spread = (sample * good * bad * (total - sample) / (float(total) ** 2 * max(total - 1, 1))) ** 0.5
    reach = int(10 * spread) + 20
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    up = np.log((good - k[:-1]) * (sample - k[:-1])) - np.log((k[:-1] + 1) * (bad - sample + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(up)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, np.searchsorted(weights, rng.random() * weights[-1], side="right"))])


def communication_matrix(blocks: list[int], shards: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Rows that go from each block to each shard; row sums are ``blocks``, column sums ``shards``."""
    left, out = list(shards), []
    for n in blocks:
        row, rest, todo = [], sum(left), n
        for j, room in enumerate(left):
            rest -= room
            take = hypergeometric(room, rest, todo, rng)
            row.append(take)
            todo -= take
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shuffle_into(rows: DataFrame, shards: int = 24, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``: counts at most one apart, slots gapless from 0."""
    spark = rows.sparkSession
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    fixed = written(rows.select(*own).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    dealt = fixed.withColumn("_k1", F.xxhash64(F.lit(seed), "_row"))
    total = fixed.count()
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    dealt = dealt.withColumn("_block", F.pmod("_k1", F.lit(n_blocks)).cast("int"))
    counts = sorted((r["_block"], r["count"]) for r in dealt.groupBy("_block").count().collect())  # one number a block
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, np.random.default_rng(seed))
    ends = [(b, np.cumsum(row).tolist()) for (b, _), row in zip(counts, matrix)]
    ends_df = spark.createDataFrame(ends, "_block int, _ends array<long>")  # blocks x shards numbers

    inside = Window.partitionBy("_block").orderBy("_k1", "_row")
    split = max(8, -(-total // (shards * bucket_rows)))
    k2 = F.xxhash64(F.lit(seed + 1), "_row")
    sent = dealt.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(ends_df), "_block")
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_at"))).cast("int")).withColumns({
        "_k2": k2, "_part": F.pmod(F.shiftright(k2, 20), F.lit(split)).cast("int")}).drop("_ends", "_at", "_block", "_k1")
    sent = written(sent, "shard-sent")

    parts = sent.groupBy("shard", "_part").count()
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    again = Window.partitionBy("shard", "_part").orderBy("_k2", "_row")
    return sent.join(starts, ["shard", "_part"]).withColumn(
        "slot", (F.col("_before") + F.row_number().over(again) - 1).cast("long")).select(*own, "shard", "slot")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id with the size and checksum of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
