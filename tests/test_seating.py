from __future__ import annotations

import json
from datetime import date, timedelta

from cinema import BASE, NOON, at, hold, money
from frames import rows

from marquee.operators import seating
from marquee.sources.generators import build_seats, build_showtimes, date_series, explode_int_series, int_series

HOLDS = [
    hold(1, 10, 101, status="BOOKED"),
    hold(2, 10, 102, status="HELD", expires=NOON + timedelta(minutes=1)),
    hold(3, 10, 103, status="HELD", expires=NOON - timedelta(minutes=1)),
    hold(4, 10, 104, status="HELD", expires=NOON),
    hold(5, 10, 105, status="CONFIRMED"),
]


def test_active_holds_against_taken_seats(make_model):
    m = make_model(**BASE, reservation_holds=HOLDS)
    assert rows(seating.active_holds(m["reservation_holds"], NOON), "id") == [(1,), (2,)]
    assert rows(seating.active_holds(m["reservation_holds"], NOON, 10, 102), "id") == [(2,)]
    assert {s for _, s in rows(seating.seat_map(m, 10), "seat_id", "status")} == {"TAKEN"}
    assert seating.available_seats(m, 10).count() == 0
    assert rows(seating.hold_status_counts(m["reservation_holds"], NOON)) == [(10, 5, 2, 1, 2)]


def test_seat_map_keeps_one_row_per_slot(make_model):
    m = make_model(**BASE, reservation_holds=[hold(1, 10, 101), hold(2, 10, 101), hold(3, 12, 101)])
    status = dict(rows(seating.seat_map(m, 10), "seat_id", "status"))
    assert status == {101: "TAKEN", **{100 + n: "available" for n in range(2, 6)}}
    assert [r["number"] for r in seating.seat_map_of(m, 10).collect()] == [1, 2, 3, 4, 5]
    assert seating.seat_map(m).count() == 15


def test_availability_per_showtime(make_model):
    m = make_model(**BASE, reservation_holds=[hold(n, 10, 100 + n) for n in range(1, 6)] + [hold(9, 12, 201)])
    arrays = {r["showtime_id"]: r["seat_ids"] for r in seating.available_seat_arrays(m).collect()}
    assert arrays == {11: [101, 102, 103, 104, 105], 12: [202, 203, 204, 205]}
    occupancy = {r["showtime_id"]: r for r in seating.seat_occupancy(m).collect()}
    assert occupancy[10]["first_available"] is None and occupancy[10]["occupancy"] == 1.0
    assert occupancy[12]["first_available"] == "A2" and occupancy[12]["taken_seats"] == 1


def test_schedule(make_model):
    m = make_model(**BASE)
    got = seating.schedule(m, date(2025, 11, 8)).collect()
    assert [(r["id"], r["title"], r["price"]) for r in got] == [(1, "Red", money(250))]
    assert json.loads(got[0]["showtimes"]) == [{"id": 10, "time": "10:30"}, {"id": 11, "time": "14:00"}]
    assert seating.schedule(m, None).count() == 0


def test_first_claim(spark):
    claims = spark.createDataFrame(
        [(10, 1, 7, at("2025-01-01 10:00:00")), (10, 1, 5, at("2025-01-01 10:00:00")), (10, 2, 9, NOON)],
        "showtime_id long, seat_id long, request_id long, requested_at timestamp_ntz",
    )
    assert rows(seating.slot_first_claim(claims), "showtime_id", "seat_id", "request_id") == [(10, 1, 5), (10, 2, 9)]


def test_generators(spark, make_model):
    m = make_model(**BASE)
    assert [r[0] for r in int_series(spark, 3, 5).collect()] == [3, 4, 5]
    assert date_series(spark, date(2024, 2, 28), date(2024, 3, 1)).count() == 3
    sizes = spark.createDataFrame([("a", 3), ("b", 0), ("c", 25_001)], "k string, n int")
    series = explode_int_series(sizes, "n", "i").groupBy("k").agg({"i": "sum", "*": "count"})
    assert rows(series, "k", "sum(i)", "count(1)") == [("a", 6, 3), ("c", 25_001 * 25_002 // 2, 25_001)]
    seats = build_seats(m["auditoriums"])
    assert seats.count() == seats.distinct().count() == 400
    shows = build_showtimes(m["movies"], date(2025, 1, 1), m["movies"]["id"]).collect()
    assert len(shows) == 2 * 7 * 3
    windows = {1: (10, 12), 2: (13, 16), 3: (17, 21)}
    for show in shows:
        low, high = windows[show["slot"]]
        assert low <= show["start_time"].hour <= high and show["start_time"].minute in (0, 30)
