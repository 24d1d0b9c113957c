"""Dashboard queries and report tables over the booking fact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import money_avg, money_sum

REVENUE_DAYS = 30
TOP_MOVIES = 10


def analytics_summary(fact: DataFrame) -> DataFrame:
    """One row of totals, also for an empty fact."""
    return fact.agg(
        F.countDistinct("customer_id").alias("total_customers"),
        F.count(F.lit(1)).alias("total_bookings"),
        F.sum("seats_booked").alias("total_seats_sold"),
        money_sum("total_revenue").alias("total_revenue"),
        money_avg("total_revenue").alias("avg_booking_value"),
    )


def daily_revenue(fact: DataFrame, as_of: date, days: int = REVENUE_DAYS) -> DataFrame:
    """Revenue per day since ``days`` days before ``as_of``; the first day counts, and there is
    no upper bound."""
    recent = fact.filter(F.col("booking_date") >= F.date_sub(F.lit(as_of), days))
    return (
        recent.groupBy("booking_date")
        .agg(
            money_sum("total_revenue").alias("daily_revenue"),
            F.count(F.lit(1)).alias("bookings"),
            F.sum("seats_booked").alias("seats_sold"),
        )
        .orderBy(F.desc("booking_date"))
    )


def top_movies(fact: DataFrame, n: int = TOP_MOVIES) -> DataFrame:
    """Best-selling titles. Movies that share a title count as one."""
    return (
        fact.groupBy("movie_title")
        .agg(
            money_sum("total_revenue").alias("total_revenue"),
            F.sum("seats_booked").alias("total_seats"),
            F.countDistinct("booking_date").alias("days_shown"),
            money_avg("total_revenue").alias("avg_revenue_per_booking"),
        )
        .orderBy(F.desc("total_revenue"), "movie_title")
        .limit(n)
    )


def _by_slot(fact: DataFrame, revenue: str, seats: str) -> DataFrame:
    return (
        fact.groupBy("time_of_day", "day_of_week")
        .agg(
            F.count(F.lit(1)).alias("booking_count"),
            money_sum("total_revenue").alias(revenue),
            F.avg("seats_booked").alias(seats),
        )
        .orderBy(F.desc("booking_count"), "time_of_day", "day_of_week")
    )


def timeslots(fact: DataFrame) -> DataFrame:
    return _by_slot(fact, "revenue", "avg_seats")


def mv_daily_revenue(fact: DataFrame) -> DataFrame:
    """Revenue per day, title and auditorium. Fact ids are unique, so rows are counted."""
    return (
        fact.groupBy("booking_date", "movie_title", "auditorium_name")
        .agg(
            money_sum("total_revenue").alias("total_revenue"),
            F.sum("seats_booked").alias("total_seats"),
            F.count(F.lit(1)).alias("total_bookings"),
            money_avg("total_revenue").alias("avg_transaction_value"),
        )
        .orderBy(F.desc("booking_date"), F.desc("total_revenue"), "movie_title", "auditorium_name")
    )


def mv_movie_performance(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("movie_title")
        .agg(
            F.countDistinct("booking_date").alias("days_shown"),
            F.sum("seats_booked").alias("total_seats_sold"),
            money_sum("total_revenue").alias("total_revenue"),
            F.avg("seats_booked").alias("avg_seats_per_booking"),
            F.countDistinct("showtime_id").alias("total_showtimes"),
        )
        .orderBy(F.desc("total_revenue"), "movie_title")
    )


def mv_timeslot_analysis(fact: DataFrame) -> DataFrame:
    return _by_slot(fact, "total_revenue", "avg_seats_per_booking")


def etl_summary(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("total_fact_records"),
        F.sum("seats_booked").alias("total_seats"),
        money_sum("total_revenue").alias("total_revenue"),
        F.min("booking_date").alias("earliest_booking"),
        F.max("booking_date").alias("latest_booking"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("movie_id").alias("unique_movies"),
    )


def booking_distribution(fact: DataFrame, n: int = 10) -> DataFrame:
    """Bookings and revenue of the ``n`` latest days."""
    return (
        fact.groupBy(F.col("booking_date").alias("date"))
        .agg(F.count(F.lit(1)).alias("bookings"), money_sum("total_revenue").alias("revenue"))
        .orderBy(F.desc("date"))
        .limit(n)
    )
