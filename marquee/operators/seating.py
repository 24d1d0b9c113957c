"""Schedules, seat maps and availability."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import ntz
from ..sources.snapshots import Model


def schedule(m: Model, show_date: date | None) -> DataFrame:
    """Movies shown on one date with their showtimes as a JSON array in time order.

    The date is written as a range so that it reaches the Parquet scan. Without a date nothing
    matches. One array holds what one movie shows on one day.
    """
    if show_date is None:
        today = F.lit(False)
    else:
        midnight = datetime.combine(show_date, time())
        start = F.col("start_time")
        today = (start >= ntz(midnight)) & (start < ntz(midnight + timedelta(days=1)))
    shows = m["showtimes"].filter(today).select(
        F.col("movie_id").alias("id"), F.struct("start_time", F.col("id").alias("show_id")).alias("show")
    )

    def entry(show):
        return F.struct(show["show_id"].alias("id"), F.date_format(show["start_time"], "HH:mm").alias("time"))

    return (
        m["movies"]
        .join(shows, "id")
        .groupBy("id", "title", "price")
        .agg(F.to_json(F.transform(F.array_sort(F.collect_list("show")), entry)).alias("showtimes"))
        .orderBy("title", "id")
    )


def halls_of_showtimes(m: Model, showtime_id: int | None = None) -> DataFrame:
    """One row per showtime: the seats of its auditorium and the ids of those taken, as arrays.

    None takes all showtimes; for one, only the seats of its auditorium are gathered. Holds meet
    showtimes as one array each, and seats as one per auditorium; neither array can outgrow an
    auditorium, and no row per taken seat is shuffled. Seats are many more bytes than a plan that
    unfolds them foresees, so they are never sent whole through the driver.
    """
    shows, holds = m["showtimes"], m["reservation_holds"].select("showtime_id", "seat_id")
    seats = m["seats"]
    if showtime_id is not None:
        shows = shows.filter(F.col("id") == showtime_id)
        holds = holds.filter(F.col("showtime_id") == showtime_id)
        seats = seats.join(shows.select("auditorium_id"), "auditorium_id", "left_semi")
    taken = holds.groupBy("showtime_id").agg(F.collect_set("seat_id").alias("taken"))
    seat = F.struct(F.col("id").alias("seat_id"), "row_code", "number")
    halls = (
        seats.join(m["auditoriums"].select(F.col("id").alias("auditorium_id")), "auditorium_id", "left_semi")
        .groupBy("auditorium_id")
        .agg(F.array_sort(F.collect_list(seat)).alias("seats"))
    )
    return (
        shows.select(F.col("id").alias("showtime_id"), "auditorium_id")
        .join(taken, "showtime_id", "left")
        .join(halls.hint("merge"), "auditorium_id")
        .select(
            "showtime_id", "seats", F.coalesce("taken", F.array().cast("array<bigint>")).alias("taken")
        )
    )


def _is_taken(seat_id: Column) -> Column:
    return F.array_contains("taken", seat_id)


def free_seats() -> Column:
    """Seats of the hall that are not taken."""
    return F.filter("seats", lambda s: ~_is_taken(s["seat_id"]))


def seat_map(m: Model, showtime_id: int | None = None) -> DataFrame:
    """Status of every seat: TAKEN with any hold, of any status and age, else available.

    One row per slot: the source allows one hold per slot, and where a feed breaks that rule
    the copies fold into one (``double_bookings`` lists them).
    """
    return (
        halls_of_showtimes(m, showtime_id)
        .select("showtime_id", "taken", F.inline("seats"))
        .select(
            "showtime_id",
            "seat_id",
            "row_code",
            "number",
            F.when(_is_taken(F.col("seat_id")), "TAKEN").otherwise("available").alias("status"),
        )
    )


def seat_map_of(m: Model, showtime_id: int) -> DataFrame:
    """The seat map of one showtime in row and seat order."""
    return seat_map(m, showtime_id).orderBy("row_code", "number")


def available_seats(m: Model, showtime_id: int | None = None) -> DataFrame:
    """Slots without any hold."""
    return halls_of_showtimes(m, showtime_id).select("showtime_id", F.inline(free_seats()))


def available_seat_arrays(m: Model) -> DataFrame:
    """Free seat ids per showtime in id order, and how many; a showtime with none has no row."""
    ids = F.transform(free_seats(), lambda s: s["seat_id"])
    return (
        halls_of_showtimes(m)
        .select("showtime_id", F.array_sort(ids).alias("seat_ids"))
        .withColumn("seat_count", F.size("seat_ids"))
        .filter("seat_count > 0")
    )


def seat_occupancy(m: Model) -> DataFrame:
    """Taken and free seats per showtime, the rate, and the first free seat by row and number."""
    position = F.transform("free", lambda s: F.struct(s["row_code"].alias("row"), s["number"].alias("number")))
    total, left = F.size("seats").cast("bigint"), F.size("free").cast("bigint")
    return (
        halls_of_showtimes(m)
        .withColumn("free", free_seats())
        .withColumn("first_free", F.array_min(position))
        .select(
            "showtime_id",
            total.alias("total_seats"),
            (total - left).alias("taken_seats"),
            left.alias("available_seats"),
            ((total - left).cast("double") / total).alias("occupancy"),
            F.concat(F.col("first_free.row"), F.col("first_free.number").cast("string")).alias(
                "first_available"
            ),
        )
    )


def hold_status_counts(holds: DataFrame, as_of: datetime) -> DataFrame:
    """Holds per showtime: all, active, held and still running, held but expired."""
    now = ntz(as_of)
    held = F.col("status") == "HELD"
    running = held & (F.col("hold_expires_at") > now)
    return holds.groupBy("showtime_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("status") == "BOOKED") | running).alias("active"),
        F.count_if(running).alias("held"),
        F.count_if(held & (F.col("hold_expires_at") <= now)).alias("expired"),
    )


def active_holds(
    holds: DataFrame,
    as_of: datetime,
    showtime_id: int | None = None,
    seat_id: int | None = None,
) -> DataFrame:
    """Holds that block a seat on the hold path: booked, or held and not yet expired."""
    now = ntz(as_of)
    active = holds.filter(
        (F.col("status") == "BOOKED")
        | ((F.col("status") == "HELD") & (F.col("hold_expires_at") > now))
    )
    for column, value in (("showtime_id", showtime_id), ("seat_id", seat_id)):
        if value is not None:
            active = active.filter(F.col(column) == value)
    return active


def released_holds(holds: DataFrame, as_of: datetime) -> DataFrame:
    """Slots whose short hold has run out by ``as_of`` and that nobody booked or confirmed.

    A renewed hold runs until its latest expiry. Rows without a showtime, seat or expiry hold
    nothing.
    """
    held = F.col("status") == "HELD"
    return (
        holds.dropna(subset=["showtime_id", "seat_id"])
        .groupBy("showtime_id", "seat_id")
        .agg(
            F.max(F.when(held, F.col("hold_expires_at"))).alias("released_at"),
            F.count_if(F.col("status") != "HELD").alias("sold"),
        )
        .filter((F.col("sold") == 0) & (F.col("released_at") <= ntz(as_of)))
        .drop("sold")
    )


def slot_first_claim(claims: DataFrame) -> DataFrame:
    """First claim of each (showtime, seat) by time, then id.

    ``min`` of a struct combines before the shuffle, so a slot with very many claims is one
    row per task by then.
    """
    first = F.min(F.struct("requested_at", "request_id")).alias("first")
    return (
        claims.groupBy("showtime_id", "seat_id")
        .agg(first)
        .select(
            "showtime_id",
            "seat_id",
            F.col("first.request_id").alias("request_id"),
            F.col("first.requested_at").alias("requested_at"),
        )
    )
