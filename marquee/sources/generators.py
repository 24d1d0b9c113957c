"""Rows made from ranges: numbers, dates, seats and schedules. No cross joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import at_time
from ..functions.hashing import draw_below

SERIES_BLOCK = 10_000

# Seat rows and seats per row.
ROW_CODES = list("ABCDEFGHIJ")
SEATS_PER_ROW = 20

# The three daily slots as (slot, first hour, number of possible hours).
SHOW_SLOTS = [(1, 10, 3), (2, 13, 4), (3, 17, 5)]


def int_series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    """Whole numbers from ``first`` to ``last``, both included."""
    return spark.range(first, last + 1).select(F.col("id").alias(name))


def explode_int_series(df: DataFrame, last: str, name: str = "n") -> DataFrame:
    """Numbers from 1 to the value of a column, one output row per number.

    Long series unroll in blocks, so that no row ever carries a long array.
    """
    block = F.lit(SERIES_BLOCK).cast("bigint")
    end = F.col(last).cast("bigint")
    starts = df.filter(F.col(last) >= 1).withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("bigint"), end, block))
    )
    numbers = F.sequence(F.col("_from"), F.least(F.col("_from") + block - 1, end))
    return starts.withColumn(name, F.explode(numbers)).drop("_from")


def date_series(spark: SparkSession, first: date, last: date, name: str = "date") -> DataFrame:
    """Days from ``first`` to ``last``, both included."""
    return int_series(spark, 0, (last - first).days, "n").select(
        F.date_add(F.lit(first), F.col("n").cast("int")).alias(name)
    )


def date_sequence(bounds: DataFrame, first: str, last: str, name: str = "date") -> DataFrame:
    """Days between two date columns, one output row per day and input row."""
    return bounds.select(
        F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))).alias(name)
    )


def build_seats(auditoriums: DataFrame) -> DataFrame:
    """Ten rows of twenty seats for every auditorium."""
    rows = auditoriums.select(
        F.col("id").alias("auditorium_id"),
        F.explode(F.array(*[F.lit(code) for code in ROW_CODES])).alias("row_code"),
    )
    return rows.select(
        "auditorium_id",
        "row_code",
        F.explode(F.sequence(F.lit(1), F.lit(SEATS_PER_ROW))).alias("number"),
    )


def build_showtimes(
    movies: DataFrame, first_day: date, auditorium_of: Column, days: int = 7, seed: int = 1
) -> DataFrame:
    """Three showings per movie and day, each at a drawn hour and at minute 0 or 30."""
    slots = F.array(
        *[
            F.struct(
                F.lit(slot).alias("slot"), F.lit(hour).alias("hour"), F.lit(span).alias("span")
            )
            for slot, hour, span in SHOW_SLOTS
        ]
    )
    planned = (
        movies.select(F.col("id").alias("movie_id"), auditorium_of.alias("auditorium_id"))
        .withColumn("day_offset", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
        .withColumn("plan", F.explode(slots))
    )
    key = ["movie_id", "day_offset", F.col("plan.slot")]
    hour = F.col("plan.hour") + draw_below(F.col("plan.span"), *key, F.lit(seed), F.lit("hour"))
    minute = draw_below(F.lit(2), *key, F.lit(seed), F.lit("minute")) * 30
    return planned.select(
        "movie_id",
        "auditorium_id",
        F.col("plan.slot").alias("slot"),
        at_time(F.date_add(F.lit(first_day), F.col("day_offset")), hour, minute).alias("start_time"),
    )
