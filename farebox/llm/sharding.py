"""Uniform random sharding with exact shard sizes.

The rows lie in source partitions. How many rows of each partition go to each shard is
drawn first, as a random table with exactly those row and column sums (the law that a
uniform permutation of all rows would give). Every partition then permutes its rows and
deals them out by its line of the table, and every shard permutes what it has received.
The result is a uniform shuffle, and shard sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.staging import stage

MAX_SOURCES = 8192
BUCKET_ROWS = 50_000
NUMPY_LIMIT = 10**9  # numpy draws from smaller urns only
FEW = 64


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each source for each shard: a multivariate hypergeometric draw."""
    total = sum(counts)
    left = np.array([(total + shards - 1 - j) // shards for j in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    table = np.zeros((len(counts), shards), np.int64)
    for i, count in enumerate(counts):
        rest, behind = count, int(left.sum())
        for j in range(shards):
            behind -= int(left[j])
            take = rest if behind == 0 else _hypergeometric(rng, int(left[j]), behind, rest)
            table[i, j], rest = take, rest - take
        left -= table[i]
    return table


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from an urn of any size, by the exact law.

    Larger urns than numpy takes: every ball is taken with one chance, by two binomial draws.
    Such a set is uniform for its size, and stays so when as many as it has too many are
    taken out at random, or as many as it lacks added: again draws from an urn, but only
    about the square root as many. The last few are drawn one by one.
    """
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    if 2 * draws > total:
        return good - _hypergeometric(rng, good, bad, total - draws)
    if draws <= FEW:
        got = 0
        for i in range(draws):
            got += int(rng.integers(total - i)) < good - got
        return got
    share = draws / total  # its rounding does not matter, both draws use the same
    taken, others = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    over = taken + others - draws
    if over >= 0:
        return taken - _hypergeometric(rng, taken, others, over)
    return taken + _hypergeometric(rng, good - taken, bad - others, -over)


def random_key(seed: int) -> Column:
    return F.xxhash64(F.col("row_uid"), F.lit(seed))


def shard_rows(rows: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    Rows may repeat and may have nulls in any column: a row is told apart by where it lies
    in a staged copy, so pass only the columns that should travel. Columns named ``shard``
    or ``slot`` are replaced. An empty table gives an empty result. Same staged layout and
    seed, same result. Beyond ``MAX_SOURCES`` partitions several share a line of the table
    and are permuted together, in a sort that spills; the driver holds one number for each
    source and shard.
    """
    rows = rows.drop("shard", "slot", "row_uid")
    kept = rows.columns
    placed = stage(rows.withColumn("row_uid", F.monotonically_increasing_id()), "shard-rows")
    placed = placed.withColumn("_source", F.pmod(F.shiftright("row_uid", 33), F.lit(MAX_SOURCES)))
    found = sorted(placed.groupBy("_source").count().collect())  # at most MAX_SOURCES rows
    total = sum(r["count"] for r in found)
    table = communication_matrix([r["count"] for r in found], shards, seed)
    lines = [(r["_source"], [int(x) for x in np.cumsum(line)]) for r, line in zip(found, table)]
    spark = rows.sparkSession
    ends = spark.createDataFrame(lines, "_source long, _ends array<long>")
    local = Window.partitionBy("_source").orderBy(random_key(seed), "row_uid")
    dealt = (
        placed.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(ends), "_source")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
    )
    buckets = max(64, -(-total // (shards * BUCKET_ROWS)))
    key = random_key(seed + 1)
    dealt = dealt.withColumn("_key", key).withColumn(
        "_bucket", F.pmod(F.shiftright("_key", 20), F.lit(buckets)).cast("int")
    )
    dealt = stage(dealt.select(*kept, "shard", "row_uid", "_key", "_bucket"), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inner = Window.partitionBy("shard", "_bucket").orderBy("_key", "row_uid")
    ranked = dealt.withColumn("_in", F.row_number().over(inner) - 1)
    return ranked.join(starts, ["shard", "_bucket"]).select(
        *kept, "shard", (F.col("_start") + F.col("_in")).cast("long").alias("slot")
    )
