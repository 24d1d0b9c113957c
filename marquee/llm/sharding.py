"""Uniform sharding by a hypergeometric communication matrix.

Rows are dealt to hash buckets. How many rows of each bucket go to each shard is drawn first:
the matrix has the bucket counts as row sums and the exact shard sizes as column sums, each of
its rows a multivariate hypergeometric draw from what the shards have left. Each bucket then
permutes its rows and gives the drawn numbers away in that order, the rows are exchanged, and
each shard permutes what it received. All orders of all rows are equally likely, and the shard
sizes are at most one apart.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store, unused

#: Rows a bucket should hold, and the bounds of the number of buckets: only their counts, and
#: for each shard a number of rows to send, are on the driver.
BUCKET_ROWS = 200_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16


def shard_sizes(n: int, n_shards: int) -> list[int]:
    """Sizes that add up to ``n`` and are at most one apart, the larger first."""
    return [n // n_shards + (i < n % n_shards) for i in range(n_shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad`` without replacement, for counts of any size.

    Inversion over the weights around the mode, which follow from the ratios of neighbours, so
    that no factorial of a large number loses digits. Weights beyond 45 deviations are nothing.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    share = good / total
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / max(1, total - 1))
    mode = min(high, max(low, int((drawn + 1) * ((good + 1) / (total + 2)))))
    reach = int(45 * spread) + 45
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = np.log((good - k[:-1]) * (drawn - k[:-1])) - np.log((k[1:]) * (bad - drawn + k[1:]))
    weight = np.concatenate([[0.0], np.cumsum(up)])
    weight = np.exp(weight - weight.max())
    at = np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")
    return int(k[min(at, len(k) - 1)])


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Random counts with these row and column sums, as if all rows were shuffled and dealt."""
    rng = np.random.default_rng(seed)
    left = list(columns)
    matrix = []
    for count in rows:
        line, rest = [], sum(left)
        for j, room in enumerate(left):
            rest -= room
            line.append(hypergeometric(rng, room, rest, count))
            count -= line[-1]
            left[j] -= line[-1]
        matrix.append(line)
    return matrix


def shard(df: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Add ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    The order depends on the values of the rows and the seed alone, so reruns agree however the
    input is partitioned. Rows that are equal in every column are interchangeable. Nulls are
    values like others, and an empty table gives an empty result. Columns named ``shard`` and
    ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    spark, columns = df.sparkSession, list(df.columns)
    bucket, first, second, rank, cuts = unused(df, "bucket", "first", "second", "rank", "cuts")
    n = df.count()
    n_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(n / BUCKET_ROWS)))
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *[df[c] for c in columns])
    dealt = df.select(
        *columns,
        F.pmod(draw(0), F.lit(n_buckets)).cast("int").alias(bucket),
        draw(1).alias(first),
        draw(2).alias(second),
    )

    held = dict(dealt.groupBy(bucket).count().collect())  # a count for each bucket
    matrix = communication_matrix(
        [held.get(i, 0) for i in range(n_buckets)], shard_sizes(n, n_shards), seed
    )
    ends = [(i, [sum(line[: j + 1]) for j in range(n_shards)]) for i, line in enumerate(matrix)]
    ends = spark.createDataFrame(ends, f"{bucket} int, {cuts} array<bigint>")

    local = Window.partitionBy(bucket).orderBy(first, second)
    sent = (
        dealt.withColumn(rank, F.row_number().over(local))
        .join(ends, bucket)
        .withColumn("shard", F.size(F.filter(cuts, lambda end: end < F.col(rank))))
        .withColumn(bucket, F.pmod(F.col(second), F.lit(n_buckets)).cast("int"))
        .select(*columns, "shard", bucket, first, second)
    )
    sent = store(sent, "sharding-exchange")

    # The second permutation, in parts of a shard that follow one another.
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sent.groupBy("shard", bucket)
        .agg(F.count("*").alias(rank))
        .withColumn(cuts, F.coalesce(F.sum(rank).over(before), F.lit(0)))
        .drop(rank)
    )
    inside = Window.partitionBy("shard", bucket).orderBy(second, first)
    return (
        sent.withColumn(rank, F.row_number().over(inside))
        .join(parts, ["shard", bucket])
        .withColumn("slot", F.col(cuts) + F.col(rank) - 1)
        .select(*columns, "shard", "slot")
    )
