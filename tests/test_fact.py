from __future__ import annotations

from frames import rows
from cinema import BASE, NOON, at, hold, money
from pyspark.sql import functions as F

from marquee.operators import integrity
from marquee.plans.fact import booking_lines, fact_bookings
from marquee.plans.reconciliation import feed_freshness, recon_counts, recon_payments_vs_fact
from marquee.sources.schemas import FACT_BOOKINGS


def payment(number, amount=500, when=NOON, customer=1, method="CASH"):
    return (number, customer, money(amount), when, method)


def test_equal_payments_share_a_row_and_count_revenue_once(make_model):
    m = make_model(
        **BASE,
        payments=[payment(1), payment(2)],
        reservation_holds=[hold(1, 10, 101), hold(2, 10, 102)],
        tickets=[(1, 1, 1, money(250)), (2, 2, 2, money(250))],
    )
    fact = fact_bookings(m)
    assert rows(fact, "seats_booked", "total_revenue") == [(2, money(500))]
    gap = recon_payments_vs_fact(m, fact).first()
    assert gap["source_revenue"] == money(1000) and gap["revenue_gap"] == money(500)
    assert gap["source_seats"] == gap["fact_seats"] == 2
    assert rows(recon_counts(m["payments"], fact)) == [(2, 1, 1)]


def test_payment_over_two_showtimes_counts_fully_on_both(make_model):
    m = make_model(
        **BASE,
        payments=[payment(1)],
        reservation_holds=[hold(1, 10, 101), hold(2, 11, 102), hold(3, 11, 103)],
        tickets=[(n, n, 1, money(250)) for n in (1, 2, 3)],
    )
    assert rows(fact_bookings(m), "showtime_id", "seats_booked", "total_revenue") == [
        (10, 1, money(500)),
        (11, 2, money(500)),
    ]
    assert booking_lines(m).count() == 3


def test_payment_without_tickets_is_dropped_and_listed(make_model):
    m = make_model(**BASE, payments=[payment(1), payment(2, 900)],
                   reservation_holds=[hold(1, 10, 101)], tickets=[(1, 1, 1, money(250))])
    assert rows(fact_bookings(m), "total_revenue") == [(money(500),)]
    assert rows(integrity.payments_without_tickets(m), "id") == [(2,)]
    assert rows(integrity.payment_amount_mismatch(m), "payment_id", "ticket_total") == [(1, money(250))]


def test_payment_without_date_is_left_out_and_reported(make_model):
    m = make_model(
        **BASE,
        payments=[payment(1), payment(2, when=None)],
        reservation_holds=[hold(1, 10, 101), hold(2, 10, 102)],
        tickets=[(1, 1, 1, money(250)), (2, 2, 2, money(250))],
    )
    assert fact_bookings(m).count() == 1
    broken = integrity.integrity_not_null(m).filter("violations > 0")
    assert rows(broken) == [("payments", "payment_date", 1)]


def test_schema_calendar_and_unique_ids(make_model):
    m = make_model(
        **BASE,
        payments=[payment(n, when=at(f"2024-12-{n:02d} 21:05:00")) for n in range(1, 31)],
        reservation_holds=[hold(n, 12, 200 + n) for n in range(1, 31)],
        tickets=[(n, n, n, money(300)) for n in range(1, 31)],
    )
    fact = fact_bookings(m)
    assert [(f.name, f.dataType) for f in fact.schema] == [(f.name, f.dataType) for f in FACT_BOOKINGS]
    assert fact.select("id").distinct().count() == 30
    last = fact.orderBy(F.desc("booking_timestamp")).first()
    assert (last["day_of_week"], last["week_of_year"], last["year"]) == ("Monday", 1, 2024)
    assert (last["booking_time"], last["time_of_day"], last["is_weekend"]) == ("21:05:00", "Evening", False)
    assert last["movie_title"] == "Blue" and last["auditorium_name"] == "Cinema 2"
    padded = fact_bookings(m, pg_padded=True).filter(F.dayofmonth("booking_date") == 30).first()
    assert padded["day_of_week"] == "Monday   " and padded["month_name"] == "December "


def test_freshness(make_model):
    m = make_model(**BASE, payments=[payment(1), payment(2, when=at("2025-11-07 12:01:30"))],
                   reservation_holds=[hold(1, 10, 101)], tickets=[(1, 1, 1, money(250))])
    assert feed_freshness(m["payments"], fact_bookings(m)).first()["lag_seconds"] == 90


def test_integrity_reports(make_model):
    m = make_model(
        customers=[(1, "a@x", "A"), (2, "a@x", "B"), (3, None, "x" * 300)],
        movies=[(1, "Red", 100, money(1))],
        showtimes=[(10, 1, 9, NOON), (11, 7, None, NOON)],
        reservation_holds=[hold(1, 10, 5, 1), hold(2, 10, 5, 1), hold(3, 99, 5, None)],
    )
    unique = rows(integrity.integrity_unique(m))
    assert unique == [("customers(email)", "a@x", 2), ("reservation_holds(showtime_id,seat_id)", "10|5", 2)]
    orphans = dict(rows(integrity.integrity_foreign_keys(m)))
    assert orphans["showtimes.movie_id->movies"] == 1
    assert orphans["showtimes.auditorium_id->auditoriums"] == 1
    assert orphans["reservation_holds.showtime_id->showtimes"] == 1
    assert orphans["reservation_holds.customer_id->customers"] == 0
    assert orphans["reservation_holds.seat_id->seats"] == 3
    assert ("customers", "name", 1) in rows(integrity.integrity_text_length(m))
    assert ("customers", "email", 1) in rows(integrity.integrity_not_null(m))
    assert rows(integrity.double_bookings(m["reservation_holds"])) == [(10, 5, 2)]


def test_hot_payment_and_showtime(make_model, eager_skew_splitting):
    """A third of the tickets belong to one payment, most to one showtime."""
    n = 900
    m = make_model(
        **BASE,
        payments=[payment(k, amount=k + 1, customer=1 + k % 2) for k in range(n)],
        reservation_holds=[hold(k, 10 if k % 5 else 11, 101, 1) for k in range(n)],
        tickets=[(k, k, 0 if k % 3 == 0 else k, money(1)) for k in range(n)],
    )
    seats = {}
    for k in range(n):
        key = (0 if k % 3 == 0 else k, 10 if k % 5 else 11)
        seats[key] = seats.get(key, 0) + 1
    fact = fact_bookings(m).withColumn("payment", F.col("total_revenue").cast("long") - 1)
    assert rows(fact, "payment", "showtime_id", "seats_booked") == sorted(
        ((p, s, c) for (p, s), c in seats.items()), key=repr
    )
    assert fact.select("id").distinct().count() == len(seats)
