"""Booking admission: first come, first served, all seats of a request or none."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import shift
from ..session import stored
from ..sinks.keys import KEY_BUCKETS, with_surrogate_key
from ..sources.snapshots import Model
from .customers import upsert_customers
from .seating import active_holds

def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per wanted seat, with its position in the request."""
    return requests.select(
        "request_id",
        "requested_at",
        "showtime_id",
        F.posexplode("seats").alias("position", "seat"),
    ).select(
        "request_id",
        "requested_at",
        "showtime_id",
        "position",
        F.col("seat.id").alias("seat_id"),
        F.col("seat.price").alias("price"),
    )


# Why a request is rejected (fixed values).
NO_EMAIL, NO_AMOUNT, NO_SEATS = "NO_EMAIL", "NO_AMOUNT", "NO_SEATS"
UNKNOWN_SHOWTIME, UNKNOWN_SEAT, SEAT_TAKEN = "UNKNOWN_SHOWTIME", "UNKNOWN_SEAT", "SEAT_TAKEN"


def _checked(
    requests: DataFrame, showtimes: DataFrame | None, seats: DataFrame | None, paid: bool
) -> DataFrame:
    """Requests in slim form, stored, with the reason why one cannot be booked whoever else wants
    what.

    A null showtime or seat refers to nothing and is no error; unknown ones are. Neither known
    showtimes nor known seats are sent whole through the driver. What is unknown is found among the
    distinct showtimes and seats that are named and stored, so requests are shuffled for it only
    where there is much of it.
    """
    ids = F.transform("seats", lambda s: s["id"])
    reason = F.when(F.col("seats").isNull(), NO_SEATS)
    if paid:
        reason = reason.when(F.col("customer_email").isNull(), NO_EMAIL)
        reason = reason.when(F.col("payment_amount").isNull(), NO_AMOUNT)
    slim = checked = stored(
        requests.select(
            "request_id",
            "requested_at",
            "showtime_id",
            ids.alias("seat_ids"),
            reason.alias("reason"),
        )
    )
    names_seat = F.size(F.coalesce("seat_ids", F.array().cast("array<bigint>"))) > 0
    if showtimes is not None:
        unknown = _unknown(slim.filter(names_seat).select("showtime_id"), showtimes)
        if not unknown.isEmpty():
            odd = F.col("odd").isNotNull() & names_seat
            checked = (
                checked.join(unknown.withColumn("odd", F.lit(True)), "showtime_id", "left")
                .withColumn("reason", F.coalesce("reason", F.when(odd, UNKNOWN_SHOWTIME)))
                .drop("odd")
            )
    if seats is not None:
        named = slim.select("request_id", F.explode("seat_ids").alias("seat_id"))
        unknown = _unknown(named.select("seat_id"), seats)
        if not unknown.isEmpty():
            odd = named.join(unknown, "seat_id", "left_semi")
            odd = stored(odd.select("request_id", F.lit(True).alias("odd")).distinct())
            checked = (
                checked.join(odd, "request_id", "left")
                .withColumn("reason", F.coalesce("reason", F.when(F.col("odd"), UNKNOWN_SEAT)))
                .drop("odd")
            )
    return slim if checked is slim else stored(checked)


def _unknown(named: DataFrame, table: DataFrame) -> DataFrame:
    """The ids named that a table does not have, stored."""
    name = named.columns[0]
    known = table.select(F.col("id").alias(name)).hint("merge")
    return stored(named.dropna().distinct().join(known, name, "left_anti"))


def _round(undecided: DataFrame) -> DataFrame:
    """The undecided requests that have not lost yet, with ``won`` for those certain to win.

    A request that is the earliest on each of its seats wins whatever happens elsewhere, and
    whoever else wants one of those seats loses. Rows meet only in ``min`` aggregates, which
    combine before the shuffle, and in a join against one row per showtime, whose arrays cannot
    outgrow the auditorium.
    """
    turn = F.struct("requested_at", "request_id", F.size("seat_ids").alias("wanted"))
    earliest = (
        undecided.select("showtime_id", F.explode("seat_ids").alias("seat_id"), turn.alias("turn"))
        .groupBy("showtime_id", "seat_id")
        .agg(F.min("turn").alias("turn"))
    )
    winners = (
        earliest.groupBy("showtime_id", "turn")
        .agg(F.collect_list("seat_id").alias("seat_ids"))
        .filter(F.size("seat_ids") == F.col("turn.wanted"))
        .groupBy("showtime_id")
        .agg(
            F.collect_list("turn.request_id").alias("winners"),
            F.flatten(F.collect_list("seat_ids")).alias("gone"),
        )
    )
    won = F.array_contains("winners", F.col("request_id"))
    lost = ~won & F.arrays_overlap("seat_ids", "gone")
    return stored(
        undecided.drop("won")
        .join(winners, "showtime_id", "left")
        .withColumn("won", F.coalesce(won, F.lit(False)))
        .filter(~F.coalesce(lost, F.lit(False)))
        .drop("winners", "gone")
    )


def admit_bookings(
    requests: DataFrame,
    holds: DataFrame | None = None,
    showtimes: DataFrame | None = None,
    seats: DataFrame | None = None,
    paid: bool = True,
) -> DataFrame:
    """Decide every request: (request_id, accepted, rejected_seat, reason).

    Requests are served by time, then id. One taken seat, or the same seat twice in one
    request, rejects the whole request, and a rejected request takes nothing. ``holds`` are
    the slots committed before. ``rejected_seat`` is the first seat, in the order of the
    request, that was unavailable when its turn came. Requests that cannot be booked at all,
    without seats, e-mail or amount, or with a showtime or seat that is not in ``showtimes`` and
    ``seats`` (where given), are rejected first and take nothing either. Requests that are not
    ``paid`` for need neither e-mail nor amount.

    The requests are stored once in slim form. Rounds then decide winners by aggregation until
    none is undecided: each gives seats away in every open showtime, so there are at most as many
    as an auditorium has seats, and usually a handful. Last, every request is judged against the
    seats given away in its showtime; AQE may split a showtime with very many requests there.
    """
    slim = _checked(requests, showtimes, seats, paid)
    # null never equals null, so without showtime or seats there is nothing to compete for
    real = F.filter("seat_ids", lambda s: s.isNotNull())
    competes = F.coalesce(
        F.col("reason").isNull() & F.col("showtime_id").isNotNull() & (F.size(real) > 0), F.lit(False)
    )
    no_seat = F.lit(None).cast("bigint").alias("rejected_seat")
    alone = slim.filter(~competes).select(
        "request_id", F.col("reason").isNull().alias("accepted"), no_seat, "reason"
    )
    queue = slim.filter(competes).drop("reason")
    if holds is not None:
        slots = holds.select("showtime_id", "seat_id").dropna()
        if seats is not None:
            known = seats.select(F.col("id").alias("seat_id")).hint("merge")
            slots = slots.join(known, "seat_id", "left_semi")
        taken = slots.groupBy("showtime_id").agg(F.collect_set("seat_id").alias("taken"))
        queue = queue.join(taken, "showtime_id", "left")
    else:
        queue = queue.withColumn("taken", F.lit(None).cast("array<bigint>"))

    blocked = F.coalesce(F.arrays_overlap("seat_ids", "taken"), F.lit(False))
    undecided = (
        queue.filter(~blocked)
        .filter(F.size(real) == F.size(F.array_distinct(real)))
        .select("request_id", "requested_at", "showtime_id", real.alias("seat_ids"))
    )
    rounds = []
    while True:
        decided = _round(undecided)
        rounds.append(decided.filter("won"))
        undecided = decided.filter("not won")
        if undecided.isEmpty():
            break

    turn = F.struct("requested_at", "request_id")
    given = (
        reduce(DataFrame.unionByName, rounds)
        .select("showtime_id", F.explode("seat_ids").alias("seat_id"), turn.alias("since"))
        .groupBy("showtime_id")
        .agg(F.array_sort(F.collect_list(F.struct("seat_id", "since"))).alias("given"))
        .select("showtime_id", F.col("given.seat_id").alias("given"), F.col("given.since"))
    )

    def unavailable(seat, position):
        # the turn that got this seat, null while nobody has
        holder = F.get("since", (F.array_position("given", seat) - 1).cast("int"))
        return (
            (F.array_position("seat_ids", seat) <= position)
            | F.coalesce(holder < turn, F.lit(False))
            | F.coalesce(F.array_contains("taken", seat), F.lit(False))
        )

    conflicts = F.filter("seat_ids", unavailable)
    free = F.size(conflicts) == 0
    contested = queue.join(given, "showtime_id", "left").select(
        "request_id",
        free.alias("accepted"),
        F.get(conflicts, 0).alias("rejected_seat"),
        F.when(~free, SEAT_TAKEN).alias("reason"),
    )
    return alone.unionByName(contested)


def _after(existing: DataFrame):
    """First id after those in use."""
    return F.coalesce(existing.agg(F.max("id").alias("m")).scalar(), F.lit(0)) + 1


def booking_outputs(requests: DataFrame, decisions: DataFrame, m: Model) -> dict[str, DataFrame]:
    """Rows that accepted requests add: customers, payments, confirmed holds and tickets.

    New ids continue after those in use. ``request_id`` is kept for tracing. Accepted requests are
    stored, and once more with their ids, so that all tables agree; holds and tickets unfold from
    there, and no row of theirs is shuffled to get an id. ``requests`` and ``decisions`` are read once.
    """
    won = stored(requests.join(decisions.filter("accepted").select("request_id"), "request_id", "left_semi"))
    people = upsert_customers(m["customers"], won)
    # where a feed holds an e-mail twice, the oldest customer books
    by_email = people.groupBy(F.col("email").alias("customer_email")).agg(F.min("id").alias("customer_id"))
    seats = ("line", F.size(F.coalesce("seats", F.array())))
    booked = stored(
        with_surrogate_key(
            won.join(by_email, "customer_email").drop("customer_email", "customer_name"),
            ["request_id"],
            "payment_id",
            _after(m["payments"]),
            items=seats,
        )
    )
    seats = booked.select("*", F.posexplode("seats").alias("position", "seat")).withColumn(
        "line", F.col("line") + F.col("position") * F.lit(KEY_BUCKETS)
    )
    return {
        "customers": people.filter("is_new").drop("is_new"),
        "payments": booked.select(
            F.col("payment_id").alias("id"),
            "customer_id",
            F.col("payment_amount").alias("amount"),
            F.col("requested_at").alias("payment_date"),
            "payment_method",
            "request_id",
        ),
        "reservation_holds": seats.select(
            (F.col("line") + _after(m["reservation_holds"])).alias("id"),
            "showtime_id",
            F.col("seat.id").alias("seat_id"),
            "customer_id",
            shift("requested_at", "HOUR", 1).alias("hold_expires_at"),
            F.lit("CONFIRMED").alias("status"),
            "request_id",
        ),
        "tickets": seats.select(
            (F.col("line") + _after(m["tickets"])).alias("id"),
            (F.col("line") + _after(m["reservation_holds"])).alias("reservation_id"),
            "payment_id",
            F.col("seat.price").alias("price"),
            "request_id",
        ),
    }


def conflict_report(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests that lost a seat, with the message their sender gets."""
    lost = decisions.filter(F.col("reason") == SEAT_TAKEN)
    return lost.join(requests.select("request_id", "showtime_id"), "request_id").select(
        "request_id",
        "showtime_id",
        "rejected_seat",
        F.concat(F.lit("Seat ID "), F.col("rejected_seat").cast("string"), F.lit(" is unavailable.")).alias(
            "details"
        ),
    )


def conflicts_per_showtime(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    return (
        conflict_report(requests, decisions)
        .groupBy("showtime_id")
        .agg(F.count(F.lit(1)).alias("conflicts"))
    )


def hold_seats(
    requests: DataFrame,
    holds: DataFrame,
    as_of: datetime,
    reuse_expired: bool = False,
    customers: DataFrame | None = None,
    **known: DataFrame | None,
) -> dict[str, DataFrame]:
    """Short holds instead of bookings: decisions and the new HELD rows.

    By default any existing row blocks a seat, because the slot is unique in the table; with
    ``reuse_expired`` only active holds, as of ``as_of``, block, as the availability check
    intends. A hold runs for five minutes from its request. ``customers`` give the id of the
    customer with the request's e-mail, null without one. A hold is not paid for, so a request
    needs neither amount nor e-mail.
    """
    blocking = active_holds(holds, as_of) if reuse_expired else holds
    decisions = admit_bookings(requests, blocking, **known, paid=False)
    won = requests.join(decisions.filter("accepted").select("request_id"), "request_id", "left_semi")
    if customers is None:
        who = won.select("request_id", F.lit(None).cast("bigint").alias("customer_id"))
    else:
        by_email = customers.groupBy(F.col("email").alias("customer_email")).agg(
            F.min("id").alias("customer_id")
        )
        who = won.join(by_email, "customer_email", "left").select("request_id", "customer_id")
    rows = explode_requests(won).join(who, "request_id").select(
        "request_id",
        "showtime_id",
        "seat_id",
        "customer_id",
        shift("requested_at", "MINUTE", 5).alias("hold_expires_at"),
        F.lit("HELD").alias("status"),
    )
    return {"decisions": decisions, "reservation_holds": rows}
