"""What the dashboard computes on top of the report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import Col, _col
from .reports import timeslots, top_movies

# Display order of the labels; any other label comes before them.
TIME_ORDER = ["Morning", "Afternoon", "Evening", "Night", "Late Night"]


def time_of_day_rank(label: Col) -> Column:
    value = _col(label)
    rank = F.lit(-1)
    for position, name in enumerate(TIME_ORDER):
        rank = F.when(value == name, position).otherwise(rank)
    return rank


def time_of_day_totals(fact: DataFrame) -> DataFrame:
    """Time slots rolled up over the weekdays."""
    return (
        timeslots(fact)
        .groupBy("time_of_day")
        .agg(
            F.sum("booking_count").alias("booking_count"),
            F.sum("revenue").cast("decimal(20,2)").alias("revenue"),
        )
    )


def time_of_day_ordered(fact: DataFrame) -> DataFrame:
    totals = time_of_day_totals(fact).withColumn("sort_rank", time_of_day_rank("time_of_day"))
    return totals.orderBy("sort_rank", "time_of_day")


def movies_pct_of_max(fact: DataFrame) -> DataFrame:
    """The top movies with rank from 0 and revenue in percent of the best; the windows see
    only the rows of the top list."""
    best = Window.orderBy(F.desc("total_revenue"), "movie_title")
    everything = Window.partitionBy()
    revenue = F.col("total_revenue").cast("double")
    return top_movies(fact).select(
        (F.row_number().over(best) - 1).alias("rank"),
        "movie_title",
        "total_revenue",
        "total_seats",
        (revenue / F.max(revenue).over(everything) * 100).alias("pct_of_max"),
    )


def slots_pct_of_max(fact: DataFrame) -> DataFrame:
    """Time-of-day totals in display order, bookings in percent of the busiest label."""
    everything = Window.partitionBy()
    count = F.col("booking_count").cast("double")
    return (
        time_of_day_totals(fact)
        .withColumn("sort_rank", time_of_day_rank("time_of_day"))
        .withColumn("value", count / F.max(count).over(everything) * 100)
        .orderBy("sort_rank", "time_of_day")
    )
