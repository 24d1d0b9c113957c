"""The 21 sample rows against totals worked out by hand."""

from __future__ import annotations

from datetime import date

import pytest
from cinema import money
from frames import rows

from marquee.functions import calendar as cal
from marquee.operators import dashboard, reports
from marquee.sources.seed_rows import seed_fact_rows

AS_OF = date(2025, 11, 18)


@pytest.fixture(scope="module")
def seed(spark):
    return seed_fact_rows(spark, AS_OF).cache()


def test_summary(seed):
    row = reports.analytics_summary(seed).first()
    assert (row["total_customers"], row["total_bookings"], row["total_seats_sold"]) == (21, 21, 47)
    assert row["total_revenue"] == money(11500)
    assert row["avg_booking_value"] == pytest.approx(11500 / 21)


def test_movies(seed):
    got = [tuple(r) for r in reports.top_movies(seed).collect()]
    assert [(t, r, s, d) for t, r, s, d, _ in got] == [
        ("Predator: Badlands", money(2700), 9, 3),
        ("Wicked: For Good", money(2520), 9, 3),
        ("Die, My Love", money(2200), 10, 3),
        ("Quezon", money(2000), 8, 3),
        ("Meet, Greet & Bye", money(1080), 6, 2),
        ("Bugonia", money(1000), 5, 2),
    ]
    assert [round(a, 4) for *_, a in got] == [675, 840, 550, 500, 360, 333.3333]


def test_daily_revenue(seed):
    got = [tuple(r) for r in reports.daily_revenue(seed, AS_OF).collect()]
    assert got == [
        (date(2025, 11, day), money(revenue), bookings, seats)
        for day, revenue, bookings, seats in [
            (17, 4170, 5, 15),
            (16, 1750, 4, 7),
            (15, 1200, 3, 5),
            (14, 1200, 3, 6),
            (13, 560, 1, 2),
            (12, 540, 1, 3),
            (11, 500, 1, 2),
            (10, 300, 1, 1),
            (9, 880, 1, 4),
            (8, 400, 1, 2),
        ]
    ]


def test_time_of_day(seed):
    got = [(r["time_of_day"], r["booking_count"], r["revenue"]) for r in dashboard.time_of_day_ordered(seed).collect()]
    assert got == [
        ("Morning", 2, money(800)),
        ("Afternoon", 11, money(4990)),
        ("Evening", 6, money(4150)),
        ("Night", 2, money(1560)),
    ]
    values = {r["time_of_day"]: r["value"] for r in dashboard.slots_pct_of_max(seed).collect()}
    assert values["Afternoon"] == 100 and values["Evening"] == pytest.approx(600 / 11)


def test_percent_of_best_movie(seed):
    got = dashboard.movies_pct_of_max(seed).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(6))
    assert got[0]["pct_of_max"] == 100 and got[5]["pct_of_max"] == pytest.approx(1000 / 27)


def test_report_tables(seed):
    assert reports.mv_daily_revenue(seed).count() == 20
    movie = {r["movie_title"]: r for r in reports.mv_movie_performance(seed).collect()}
    assert movie["Quezon"]["total_showtimes"] == 4 and movie["Quezon"]["avg_seats_per_booking"] == 2.0
    slots = reports.mv_timeslot_analysis(seed)
    assert slots.agg({"booking_count": "sum"}).first()[0] == 21
    total = reports.etl_summary(seed).first()
    assert (total["earliest_booking"], total["latest_booking"]) == (date(2025, 11, 8), date(2025, 11, 17))
    assert (total["unique_customers"], total["unique_movies"]) == (21, 6)
    assert reports.booking_distribution(seed, 2).count() == 2


def test_typed_labels_agree_with_the_calendar(seed):
    calendar = cal.calendar_columns("booking_date")
    derived = seed.select("id", "day_of_week", "week_of_year", "is_weekend", *[
        c for c in [calendar[2].alias("d"), calendar[3].alias("w"), calendar[8].alias("e")]
    ])
    assert derived.filter("day_of_week <> d OR week_of_year <> w OR is_weekend <> e").count() == 0


def test_typed_time_labels_that_break_the_load_rule(seed):
    hour = "CAST(substr(booking_time, 1, 2) AS INT)"
    labelled = seed.selectExpr("booking_time", "time_of_day", f"{hour} AS hour")
    different = labelled.filter(cal.time_of_day_etl("hour") != labelled["time_of_day"])
    assert rows(different, "booking_time") == [("17:00:00",), ("20:30:00",), ("21:00:00",)]
