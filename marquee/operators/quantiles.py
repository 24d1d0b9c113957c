"""Exact interpolated percentiles by narrowing bins, without sorting the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bins that a range of values is cut into in each step.
BINS = 4096


def exact_quantiles(
    counts: DataFrame, group: str, value: str, weight: str, quantiles: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per group from (group, value, weight) rows.

    For every wanted rank, the range that holds it is cut into BINS bins of equal width; a count
    per bin shows which one holds the rank, and that bin's own least and greatest value are the
    next range. A step narrows a range BINS times at least, so a handful of steps ends at single
    values whatever the distribution. Rows meet only in counts, which combine before the shuffle,
    and the one window runs over the bins of one rank. Store ``counts`` if it is costly: each
    step reads it, though only the first needs all of it.
    """
    ensure_checkpoint_dir(counts.sparkSession)
    data = counts.select(
        F.col(group).alias("group"), F.col(value).alias("value"), F.col(weight).alias("weight")
    ).filter(F.col("value").isNotNull())
    # Null is a group like others, so that groups are told apart by a struct around them.
    data = data.withColumn("group", F.struct("group"))
    exact = [F.lit(p) * (F.col("total") - 1) for p in quantiles.values()]
    positions = F.array(*[x for r in exact for x in (F.floor(r), F.ceil(r))])
    ranges = (
        data.groupBy("group")
        .agg(F.sum("weight").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("group", "total", "low", "high", F.posexplode(positions).alias("which", "position"))
        .withColumn("before", F.lit(0).cast("bigint"))
        .checkpoint()
    )
    done = []
    while True:
        done.append(ranges.filter("low = high"))
        ranges = ranges.filter("low < high")
        if ranges.isEmpty():
            break
        ranges = _narrow(data, ranges).checkpoint()
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)

    values = found.groupBy("group").agg(
        F.first("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("which", "low"))).alias("at"),  # one per rank
    )

    def between(i: int, p: float) -> Column:
        low, high = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        rank = F.lit(p) * (F.col("total") - 1)
        return low + (high - low) * (rank - F.floor(rank))

    return values.select(
        F.col("group.group").alias(group),
        *[between(i, p).alias(name) for i, (name, p) in enumerate(quantiles.items())],
    )


def _narrow(data: DataFrame, ranges: DataFrame) -> DataFrame:
    """The bins that hold the positions of ``ranges``, as ranges of their own."""
    wide = F.col("high") / 2 - F.col("low") / 2  # half the width, which cannot overflow
    place = (F.col("value") / 2 - F.col("low") / 2) / wide * BINS
    bin_ = F.least(F.floor(place), F.lit(BINS - 1).cast("bigint"))
    bins = (
        data.join(ranges, "group")
        .filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
        .groupBy("group", "which", "total", "position", "before", bin_.alias("bin"))
        .agg(F.sum("weight").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    in_order = Window.partitionBy("group", "which").orderBy("bin")
    ends = bins.withColumn("end", F.col("before") + F.sum("n").over(in_order))
    start = F.col("end") - F.col("n")
    return ends.filter((start <= F.col("position")) & (F.col("position") < F.col("end"))).select(
        "group", "total", "low", "high", "which", "position", start.alias("before")
    )
