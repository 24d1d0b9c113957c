"""A small cinema to build test data on: two movies, two auditoriums, three showtimes."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.01"))


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


NOON = at("2025-11-07 12:00:00")

BASE = {
    "customers": [(1, "ann@x.com", "Ann"), (2, "bob@x.com", "Bob")],
    "movies": [(1, "Red", 100, money(250)), (2, "Blue", 120, money(300))],
    "auditoriums": [(1, "Cinema 1", 200), (2, "Cinema 2", 200)],
    "showtimes": [
        (10, 1, 1, at("2025-11-08 10:30:00")),
        (11, 1, 1, at("2025-11-08 14:00:00")),
        (12, 2, 2, at("2025-11-09 19:00:00")),
    ],
    "seats": [(100 * a + n, a, "A", n) for a in (1, 2) for n in range(1, 6)],
}


def hold(number, showtime, seat, customer=1, status="CONFIRMED", expires=NOON):
    return (number, showtime, seat, customer, expires, status)
