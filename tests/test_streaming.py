"""Streams drained with availableNow give what the batch operators give."""

from __future__ import annotations

from datetime import timedelta

from cinema import BASE, NOON, at, hold, money
from frames import SMALL, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_admission import frame, one_by_one, random_requests

from marquee.operators import seating
from marquee.plans.fact import FACT_COLUMNS, fact_bookings
from marquee.sources.schemas import CHANGE, OPERATIONAL
from marquee.sources.snapshots import load_booking_model
from marquee.sources.trade_tables import TradeTables
from marquee.streaming import jobs
from marquee.streaming.feed import PUBLISHED, read_change_feed


def land(landing, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.mode("append").parquet(f"{landing}/{name}")


def drain(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_published_tables():
    assert len(PUBLISHED) == 7 and "seats" not in PUBLISHED


def test_fact_follows_the_feed(spark, make_model, tmp_path):
    landing, fact, check = (str(tmp_path / n) for n in ("in", "fact", "check"))
    days = ["2025-10-30 10:00:00", "2025-11-02 23:30:00", "2025-11-07 09:00:00"]
    m = make_model(
        **BASE,
        payments=[(n, 1, money(100 * n), at(d), "CASH") for n, d in enumerate(days, 1)],
        reservation_holds=[hold(n, 10, 100 + n) for n in (1, 2, 3, 4)],
        tickets=[(1, 1, 1, money(1)), (2, 2, 2, money(1)), (3, 3, 3, money(1)), (4, 4, 3, money(1))],
    )
    masters = {n: m[n] for n in ("customers", "movies", "auditoriums", "showtimes", "seats")}
    first = {n: m[n].filter("id <= 2") for n in ("payments", "reservation_holds", "tickets")}
    land(landing, **masters, **first)
    drain(jobs.stream_fact_bookings(spark, landing, fact, check, available_now=True))
    assert spark.read.parquet(fact).count() == 2
    later = {n: m[n].filter("id > 2") for n in ("payments", "reservation_holds", "tickets")}
    land(landing, **later)
    for _ in range(2):  # the second run finds nothing new
        drain(jobs.stream_fact_bookings(spark, landing, fact, check, available_now=True))
    batch = fact_bookings(load_booking_model(spark, landing))
    assert rows(spark.read.parquet(fact).select(*batch.columns)) == rows(batch)


def test_daily_revenue_counts_late_payments(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    payments = TradeTables(spark, SMALL).payments().orderBy("payment_date").cache()
    for month in ("1998-01-01", "1999-06-01"):
        land(landing, payments=payments.filter(F.col("payment_date") < month))
        payments = payments.filter(F.col("payment_date") >= month)
    late = spark.createDataFrame([(-1, 1, money(5), at("1995-01-01 00:00:00"), "CASH")], OPERATIONAL["payments"])
    for more in (None, late):
        if more is not None:
            land(landing, payments=more)
        drain(jobs.stream_daily_revenue(spark, landing, out, check, available_now=True))
        batch = jobs.daily_revenue_of(spark.read.parquet(f"{landing}/payments"))
        assert rows(spark.read.parquet(out).select(*batch.columns)) == rows(batch)


CLAIMS = "showtime_id long, seat_id long, request_id long, requested_at timestamp"


def claim_in_turn(spark, tmp_path, batches):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in batches:
        land(landing, claims=spark.createDataFrame(batch, CLAIMS))
        stream = spark.readStream.schema(CLAIMS).parquet(f"{landing}/claims")
        drain(jobs.stream_first_claim(stream, out, check, available_now=True))
    return rows(spark.read.parquet(out), "showtime_id", "seat_id", "request_id")


def test_first_claim_once_per_slot(spark, tmp_path):
    batches = [
        [(1, 1, 8, NOON), (1, 1, 3, NOON), (1, 2, 4, NOON + timedelta(minutes=1))],
        [(1, 1, 1, NOON - timedelta(hours=1)), (2, 1, 9, NOON), (2, 1, 2, NOON + timedelta(seconds=1))],
        [(None, 1, 5, NOON), (1, None, 6, NOON)],
    ]
    assert claim_in_turn(spark, tmp_path, batches) == [(1, 1, 3), (1, 2, 4), (2, 1, 9)]


def test_a_claim_holds_for_ever_and_a_late_one_counts(spark, tmp_path):
    batches = [
        [(1, 1, 1, NOON)],
        [(2, 1, 2, NOON + timedelta(days=62))],
        [(1, 1, 4, NOON + timedelta(days=63))],  # the slot was given 63 days ago
        [(7, 7, 5, NOON - timedelta(days=90))],  # far behind, but nobody else wants it
    ]
    assert claim_in_turn(spark, tmp_path, batches) == [(1, 1, 1), (2, 1, 2), (7, 7, 5)]


def test_a_replayed_claim_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    for number, batch in enumerate([[(1, 1, 1, NOON)], [(1, 1, 2, NOON), (1, 2, 3, NOON)]]):
        jobs.claim_batch(spark.createDataFrame(batch, CLAIMS), number, out)
    jobs.claim_batch(spark.createDataFrame([(1, 1, 2, NOON), (1, 2, 3, NOON)], CLAIMS), 1, out)
    assert rows(spark.read.parquet(out), "seat_id", "request_id") == [(1, 1), (2, 3)]


def test_admission_over_a_stream(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    requests = sorted(random_requests(4, n=90), key=lambda r: (r[1], r[0]))
    given = [hold(1, 1, 3)]
    holds = spark.createDataFrame(given, OPERATIONAL["reservation_holds"])
    for part in (requests[:30], requests[30:60], requests[60:]):
        land(landing, booking_requests=frame(spark, part))
        feed = read_change_feed(spark, landing, "booking_requests")
        drain(jobs.stream_admit_bookings(feed, out, check, holds, True))
    got = spark.read.parquet(f"{out}/decisions").select("request_id", "accepted", "rejected_seat")
    assert rows(got) == one_by_one(requests, given)
    batch = frame(spark, requests[60:])
    jobs.admit_batch(batch, 2, holds, out)  # a replayed batch changes nothing
    assert rows(spark.read.parquet(f"{out}/decisions").select(*got.columns)) == one_by_one(requests, given)


def expire(spark, tmp_path, batches):
    """Releases as (seat, time) after batches of (minute of the clock, hold rows)."""
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    everything = []
    for minute, batch in batches:
        now = NOON + timedelta(minutes=minute)
        everything += batch
        land(landing, reservation_holds=spark.createDataFrame(batch, OPERATIONAL["reservation_holds"]))
        feed = read_change_feed(spark, landing, "reservation_holds")
        drain(jobs.stream_hold_expiry(feed, out, check, lambda now=now: now, available_now=True))
    released = spark.read.schema(jobs.RELEASED).parquet(f"{out}/released")
    return rows(released.select("seat_id", F.date_format("released_at", "HH:mm"))), everything, now


def held(number, seat, status, minutes):
    return hold(number, 10, seat, status=status, expires=NOON + timedelta(minutes=minutes))


def test_expired_holds_release_their_seat(spark, tmp_path):
    got, everything, now = expire(
        spark,
        tmp_path,
        [
            (0, [held(1, 1, "HELD", 5), held(2, 2, "HELD", 5), held(3, 3, "HELD", 5)]),
            (4, [held(4, 2, "BOOKED", 6), held(5, 3, "HELD", 30)]),
            (20, [held(6, 9, "HELD", 60)]),
            (31, [held(7, 9, "HELD", 61), held(1, 1, "HELD", 5)]),  # a row delivered twice
        ],
    )
    assert got == [(1, "12:05"), (3, "12:30")]
    holds = spark.createDataFrame(everything, OPERATIONAL["reservation_holds"])
    batch = seating.released_holds(holds, now)
    assert rows(batch.select("seat_id", F.date_format("released_at", "HH:mm"))) == got


def test_a_confirmed_hold_is_never_released(spark, tmp_path):
    """Confirmed rows expire an hour later, and must neither hasten nor lose a release."""
    got, everything, now = expire(
        spark,
        tmp_path,
        [
            (0, [held(1, 1, "CONFIRMED", 60)]),
            (2, [held(2, 2, "HELD", 5), held(3, 3, "HELD", 6)]),
            (3, [held(4, 2, "CONFIRMED", 62)]),
            (4, [held(5, 4, "HELD", 7)]),
            (8, [held(6, 5, "HELD", 12)]),
            (70, [held(7, 2, "HELD", 5)]),  # a hold that arrives after it was confirmed
        ],
    )
    assert got == [(3, "12:06"), (4, "12:07"), (5, "12:12")]
    holds = spark.createDataFrame(everything, OPERATIONAL["reservation_holds"])
    assert rows(seating.released_holds(holds, now), "seat_id") == [(3,), (4,), (5,)]


def test_changes_and_deletions_of_the_feed(spark, make_model, tmp_path):
    """The latest version of a payment counts, in the month it is in; a deleted one is gone."""
    landing, fact, check = (str(tmp_path / n) for n in ("in", "fact", "check"))
    m = make_model(
        **BASE,
        payments=[(n, 1, money(100 * n), at(f"2025-1{n}-01 10:00:00"), "CASH") for n in (0, 1, 2)],
        reservation_holds=[hold(n, 10, 100 + n) for n in (1, 2, 3)],
        tickets=[(n + 1, n + 1, n, money(1)) for n in (0, 1, 2)],
    )
    land(landing, **{n: m[n] for n in OPERATIONAL})
    drain(jobs.stream_fact_bookings(spark, landing, fact, check, available_now=True))
    assert spark.read.parquet(fact).count() == 3
    schema = T.StructType([*OPERATIONAL["payments"].fields, *CHANGE.fields])
    moved = [
        (1, 1, money(7), at("2025-10-05 09:00:00"), "CASH", "UPDATE", 2),
        (1, 1, money(5), at("2025-12-05 09:00:00"), "CASH", "UPDATE", 1),
        (2, 1, money(200), at("2025-12-01 10:00:00"), "CASH", "DELETE", 3),
    ]
    land(landing, payments=spark.createDataFrame(moved, schema))
    drain(jobs.stream_fact_bookings(spark, landing, fact, check, available_now=True))
    got = rows(spark.read.parquet(fact), "total_revenue", "year", "month_num")
    assert got == [(money(0), 2025, 10), (money(7), 2025, 10)]
    assert rows(spark.read.parquet(fact).select(*FACT_COLUMNS)) == rows(fact_bookings(load_booking_model(spark, landing)))


def test_tickets_that_move_or_go(spark, make_model, tmp_path):
    """The months of the payments that a ticket had before are recomputed too."""
    landing, fact, check = (str(tmp_path / n) for n in ("in", "fact", "check"))
    m = make_model(
        **BASE,
        payments=[(n, 1, money(100 * n), at(f"2025-1{n}-01 10:00:00"), "CASH") for n in (0, 1, 2)],
        reservation_holds=[hold(n, 10, 100 + n) for n in (1, 2, 3, 4)],
        tickets=[(n, n, p, money(1)) for n, p in ((1, 0), (2, 1), (3, 2), (4, 2))],
    )
    land(landing, **{n: m[n] for n in OPERATIONAL})
    drain(jobs.stream_fact_bookings(spark, landing, fact, check, available_now=True))
    assert spark.read.parquet(fact).count() == 3
    schema = T.StructType([*OPERATIONAL["tickets"].fields, *CHANGE.fields])
    moved = (1, 1, 1, money(1), "UPDATE", 1)  # from October to November
    gone = (4, None, None, None, "DELETE", 2)  # the key alone
    for change, months in ((moved, [11, 12]), (gone, [11, 12]), ((3, None, None, None, "DELETE", 3), [11])):
        land(landing, tickets=spark.createDataFrame([change], schema))
        drain(jobs.stream_fact_bookings(spark, landing, fact, check, available_now=True))
        got = spark.read.parquet(fact)
        assert sorted(r.month_num for r in got.select("month_num").collect()) == months
        batch = fact_bookings(load_booking_model(spark, landing))
        assert rows(got.select(*FACT_COLUMNS)) == rows(batch.select(*FACT_COLUMNS))
