"""The core load: operational tables to the booking fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, time_of_day_etl
from ..sinks.keys import with_surrogate_key
from ..sources.schemas import FACT_BOOKINGS
from ..sources.snapshots import Model

FACT_COLUMNS = [f.name for f in FACT_BOOKINGS.fields]
# One fact row per distinct value of these. Payment id is deliberately not among them:
# payments that agree on everything here share one row.
GRAIN = ["payment_date", "showtime_id", "customer_id", "amount", "payment_method"]


def showings(m: Model) -> DataFrame:
    """Showtimes with the attributes of their movie and auditorium."""
    movies = m["movies"].select(F.col("id").alias("movie_id"), "title", "duration_minutes", "price")
    halls = m["auditoriums"].select(
        F.col("id").alias("auditorium_id"), F.col("name").alias("auditorium_name")
    )
    shows = m["showtimes"].withColumnRenamed("id", "showtime_id")
    return shows.join(movies, "movie_id").join(halls, "auditorium_id")


def _people(m: Model) -> DataFrame:
    return m["customers"].select(
        F.col("id").alias("customer_id"), "email", F.col("name").alias("customer_name")
    )


def _ticketed(m: Model) -> DataFrame:
    """Tickets with the showtime of their reservation."""
    tickets = m["tickets"].select(F.col("id").alias("ticket_id"), "reservation_id", "payment_id")
    holds = m["reservation_holds"].select(F.col("id").alias("reservation_id"), "showtime_id")
    return tickets.join(holds, "reservation_id")


def booking_lines(m: Model) -> DataFrame:
    """One row per ticket with everything the fact is made of (seven tables, inner joins)."""
    payments = m["payments"].withColumnRenamed("id", "payment_id")
    return (
        _ticketed(m)
        .join(payments, "payment_id")
        .join(showings(m), "showtime_id")
        .join(_people(m), "customer_id")
        .select(
            "payment_id",
            "customer_id",
            "amount",
            "payment_date",
            "payment_method",
            "email",
            "customer_name",
            "ticket_id",
            "reservation_id",
            "showtime_id",
            "start_time",
            "movie_id",
            "auditorium_id",
            "title",
            "duration_minutes",
            "price",
            "auditorium_name",
        )
    )


def booked_seats(m: Model) -> DataFrame:
    """Seats (``n``) of every payment and showtime, added up at the grain of ``GRAIN``.

    Tickets shrink to one row per (payment, showtime) before they meet the payments. Payments
    without a date cannot be placed.
    """
    seats = _ticketed(m).groupBy("payment_id", "showtime_id").agg(F.count("ticket_id").alias("n"))
    payments = m["payments"].filter(F.col("payment_date").isNotNull())
    paid = seats.join(payments.withColumnRenamed("id", "payment_id"), "payment_id")
    return paid.groupBy(*GRAIN).agg(F.sum("n").alias("n"))


def month_number(column: str = "payment_date") -> Column:
    """Months since year 0, which number the fact's partitions."""
    return F.year(column) * 12 + F.month(column)


def described(booked: DataFrame, m: Model, pg_padded: bool = False, by_month: bool = False) -> DataFrame:
    """Fact rows of booked seats, with the attributes of their showtime and customer.

    The descriptive columns join last, so only narrow rows are shuffled. Showtime decides movie
    and auditorium, customer id decides e-mail and name: grouping by the ids is enough. With
    ``by_month`` rows are spread by month, before the calendar's columns are added.
    """
    counted = booked.select(*GRAIN, F.col("n").cast("int").alias("seats_booked"))
    # ids of a month do not depend on other months, so months can be rebuilt one by one
    keyed = with_surrogate_key(counted, GRAIN, within=month_number())
    rows = keyed.join(showings(m), "showtime_id").join(_people(m), "customer_id")
    if by_month:
        rows = rows.withColumn("_month", month_number()).hint("rebalance", F.col("_month"))
    return rows.select(
        "id",
        F.col("payment_date").alias("booking_timestamp"),
        "movie_id",
        F.col("title").alias("movie_title"),
        F.col("duration_minutes").alias("movie_duration"),
        F.col("price").alias("movie_price"),
        "showtime_id",
        F.col("start_time").alias("showtime_start"),
        "auditorium_id",
        "auditorium_name",
        "customer_id",
        F.col("email").alias("customer_email"),
        "customer_name",
        "seats_booked",
        F.col("amount").alias("total_revenue"),
        "payment_method",
        *calendar_columns("payment_date", pg_padded),
        time_of_day_etl(F.hour("payment_date")).alias("time_of_day"),
    ).select(*FACT_COLUMNS)


def fact_bookings(m: Model, pg_padded: bool = False) -> DataFrame:
    """Booking fact at the grain of ``GRAIN``; payments without a date are left out."""
    return described(booked_seats(m), m, pg_padded)
