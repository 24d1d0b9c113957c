"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule by which its rate changes linearly while training runs.
The integral of the rate up to time t is the number of words the source has given by then, and
it ends at the source's target. The documents of a source follow one another in a random order,
again and again until the target is reached; inverting the integral at the word where a copy
starts gives the time at which training comes to it. Sorting all copies by time is the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, unused, word_count

#: Weights, given to the sources in code point order, over and over (fixed by the contract).
WEIGHTS = (1, 2, 3)
#: A source is repeated this often at most (fixed by the contract).
MOST_REPEATS = 3
#: How much a source of each weight gains from the start to the end of training, as a share of
#: its mean rate to each side, before the shift that keeps the rate of all sources constant.
TILTS = (-0.5, 0.0, 0.5)
#: Parts of a source's order whose sums are added up before the rows inside them: with 2**k
#: parts, a source of n documents has n / 2**k of them in one task.
PART_BITS = 12


def plan(sizes: DataFrame) -> DataFrame:
    """Targets and schedules from (source, source_size): one row per source.

    Adds ``weight``, ``target`` and ``tilt``. All sizes are shared out by weight; what exceeds
    MOST_REPEATS times a source's size is shared among the others by weight until none is above,
    which is the level L at which the sum of min(cap, L * weight) is all sizes. The windows run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = F.row_number().over(by_name) - 1
    capped = (
        sizes.withColumn("turn", (turn % len(WEIGHTS)).cast("int"))
        .withColumn("weight", F.element_at(F.lit(list(WEIGHTS)), F.col("turn") + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * MOST_REPEATS)
        .withColumn("room", F.col("cap") / F.col("weight"))
    )
    filled = F.coalesce(
        F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    waiting = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - filled) / waiting
    targets = (
        capped.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("raw", F.element_at(F.lit(list(TILTS)), F.col("turn") + 1))
    )
    # The mean is taken over numbers that add up exactly in any order.
    words = F.floor("target")
    mean = F.sum(words * (F.col("raw") * 2).cast("long")).over(everything) / (
        F.greatest(F.sum(words).over(everything), F.lit(1)) * 2
    )
    return targets.withColumn("tilt", F.col("raw") - mean).select(
        "source", "source_size", "weight", "target", "tilt"
    )


def mix(df: DataFrame, seed: int, text: str = "text", source: str = "source", key: str = "doc_id"):
    """What the mix takes of each document, and when.

    Keeps all columns and adds ``size`` (words), ``source_size``, ``target`` (of the source),
    ``taken`` (words, repeats counted) and ``positions`` (double array: the time from 0 to 1 at
    which each copy starts; the last copy may be cut where the source's demand ends). Columns of
    these names are replaced.

    A null text has size 0 and is taken 0 times. Null is a source of its own, the last one. The
    order inside a source comes from ``key``, the text and the seed, so reruns agree; rows equal
    in them are interchangeable. An empty table gives an empty result.
    """
    added = ["size", "source_size", "target", "taken", "positions"]
    df = df.drop(*added)
    columns = df.columns
    draw, part, turn, before, tilt, own = unused(df, "draw", "part", "turn", "before", "tilt", "own")
    as_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    random = F.md5(F.concat_ws(":", F.lit(str(seed)), as_text, F.coalesce(F.col(text), F.lit(""))))
    sized = df.select(
        *columns,
        word_count(F.col(text)).alias("size"),
        F.conv(F.substring(random, 1, 15), 16, 10).cast("long").alias(draw),
    ).withColumn(part, F.shiftright(draw, 60 - PART_BITS).cast("int"))
    sized = store(sized, "mixing-sizes")

    sources = plan(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size")))
    sources = store(
        sources.select(
            F.col("source").alias(own),
            "source_size",
            "target",
            F.col("tilt").alias(tilt),
            F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias(turn),
        ),
        "mixing-sources",
    )
    joined = sized.join(sources, sized[source].eqNullSafe(sources[own])).drop(own)

    sofar = Window.partitionBy(turn).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        joined.groupBy(turn, part)
        .agg(F.sum("size").alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(sofar), F.lit(0)))
    )
    inside = Window.partitionBy(turn, part).orderBy(draw).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col(before) + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        joined.join(parts, [turn, part])
        .withColumn(before, begin)
        .withColumn("taken", _taken(F.col(before)))
        .withColumn("positions", _positions(F.col(before), F.col(tilt)))
        .select(*columns, *added)
    )


def _demand() -> Column:
    """Whole words the source gives in the end."""
    return F.round("target").cast("long")


def _taken(begin: Column) -> Column:
    """Whole rounds of the source, and what the last one reaches of the document."""
    size, per_round = F.col("size"), F.greatest("source_size", F.lit(1))
    rounds = F.floor(_demand() / per_round)
    rest = _demand() - rounds * per_round - begin
    return (rounds * size + F.greatest(F.lit(0), F.least(size, rest))).cast("long")


def _positions(begin: Column, tilt: Column) -> Column:
    """Times at which the copies start: the schedule's integral, inverted.

    A rate of target * (1 + tilt * (2 t - 1)) gives target * (t + tilt * (t * t - t)) words until
    t; setting that to the words before the copy is a quadratic equation for t.
    """
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    all_rounds = F.array(*[F.lit(i) for i in range(MOST_REPEATS)])

    def start(i: Column) -> Column:
        share = (begin + i * F.col("source_size")) / F.col("target")
        other = F.lit(1.0) - tilt
        return (share * 2) / (other + F.sqrt(other * other + tilt * 4 * share))

    return F.transform(F.slice(all_rounds, 1, copies.cast("int")), start)


def in_time(rows: DataFrame, start: str, key: str = "doc_id") -> DataFrame:
    """Rows sorted by the time in column ``start``, then by ``key``, which also spreads rows of one
    time over tasks; rows without a time, which are not taken, come last."""
    order = [F.col(start).asc_nulls_last(), F.col(key)]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy that is taken whole or by half at least, sorted by position.

    Documents stay whole here: the copy at which a source's demand ends counts if half of it
    lies before that end. ``columns`` of the mixed rows are returned with ``position``.
    """
    position, whole = unused(mixed, "position", "whole")
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return (
        mixed.withColumn(whole, copies)
        .where(F.col(whole) > 0)
        .select(*columns, F.explode(F.slice("positions", 1, F.col(whole))).alias(position))
        .repartitionByRange(position)
        .sortWithinPartitions(position)
        .withColumnRenamed(position, "position")
    )
