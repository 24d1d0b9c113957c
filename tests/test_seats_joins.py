"""Seats are unfolded from auditoriums, and plans take them for no larger than those: none of their
joins may send them whole through the driver."""

from __future__ import annotations

import re

import pytest
from cinema import BASE, NOON, hold

from marquee.operators import admission, integrity, sampling, seating
from marquee.sources.generators import build_seats


def broadcast(df):
    """Kinds of the joins that broadcast a side."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"BroadcastHashJoin .*?(Inner|LeftOuter|LeftSemi|LeftAnti)", plan)


@pytest.fixture
def m(spark, make_model, tmp_path):
    """The model read from files, whose size plans know."""
    model = make_model(**BASE, reservation_holds=[hold(1, 10, 101)])
    for name, rows in model.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    model = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in model}
    seats = build_seats(model["auditoriums"]).selectExpr("auditorium_id * 1000 + number AS id", "*")
    return {**model, "seats": seats}


def test_halls_are_not_broadcast(m):
    for df in (
        seating.seat_map(m),
        seating.available_seats(m),
        seating.available_seat_arrays(m),
        seating.seat_occupancy(m),
        sampling.pick_available_seats(m, 2),
        seating.seat_map_of(m, 10),
    ):
        assert "Inner" not in broadcast(df)
    assert seating.seat_map_of(m, 10).count() == 200


def test_parents_are_not_broadcast(m):
    assert not broadcast(integrity.integrity_foreign_keys(m))


def test_known_seats_are_not_broadcast(m, spark):
    requests = spark.createDataFrame(
        [(1, NOON, 10, [(1001, None)], "a@b", 1), (2, NOON, 10, [(7, None)], "a@b", 1)],
        """request_id long, requested_at timestamp_ntz, showtime_id long,
           seats array<struct<id: long, price: decimal(10,2)>>, customer_email string, payment_amount int""",
    )
    assert "LeftAnti" not in broadcast(admission._checked(requests, m["showtimes"], m["seats"], True))
    decided = admission.admit_bookings(requests, m["reservation_holds"], m["showtimes"], m["seats"])
    assert "LeftSemi" not in broadcast(decided)
    assert sorted((r["request_id"], r["reason"]) for r in decided.collect()) == [(1, None), (2, "UNKNOWN_SEAT")]
