"""Calendar and movie dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_name, is_weekend, month_name
from ..sinks.tables import append_ignore_duplicates
from ..sources.generators import date_sequence
from ..sources.schemas import DIM_TIME


def calendar_days(days: DataFrame, pg_padded: bool = False) -> DataFrame:
    """Calendar attributes for rows with a ``date`` column."""
    return days.select(
        "date",
        day_name("date", pg_padded).alias("day_of_week"),
        F.dayofmonth("date").alias("day_of_month"),
        F.weekofyear("date").alias("week_of_year"),
        F.month("date").alias("month_num"),
        month_name("date", pg_padded).alias("month_name"),
        F.quarter("date").alias("quarter"),
        F.year("date").alias("year"),
        is_weekend("date").alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
    )


def dim_time(bounds: DataFrame, existing: DataFrame | None = None, pg_padded: bool = False) -> DataFrame:
    """Daily calendar from one year before ``first_day`` to two years after ``last_day``.

    ``bounds`` is one row with both columns; with one ``as_of`` day they are equal. Days
    already in ``existing`` keep their row.
    """
    span = bounds.select(
        F.add_months("first_day", -12).alias("lo"), F.add_months("last_day", 24).alias("hi")
    )
    days = calendar_days(date_sequence(span, "lo", "hi"), pg_padded)
    return days if existing is None else append_ignore_duplicates(existing, days, ["date"])


def calendar_bounds(spark, as_of) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return spark.range(1).select(day.alias("first_day"), day.alias("last_day"))


def dim_movies(movies: DataFrame, as_of: Column) -> DataFrame:
    """Movie dimension; the source has no genre, so it stays null."""
    return movies.select(
        F.col("id").alias("movie_id"),
        "title",
        "duration_minutes",
        F.col("price").alias("base_price"),
        F.lit(None).cast("string").alias("genre"),
        as_of.cast("timestamp_ntz").alias("last_updated"),
    )


DIM_TIME_COLUMNS = [f.name for f in DIM_TIME.fields]
