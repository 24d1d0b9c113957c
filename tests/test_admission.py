from __future__ import annotations

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from cinema import BASE, NOON, hold, money
from frames import rows
from pyspark.sql import functions as F

from marquee.operators import admission
from marquee.operators.customers import upsert_customers
from marquee.sources.schemas import BOOKING_REQUESTS, OPERATIONAL

HOLDS = OPERATIONAL["reservation_holds"]
DECIDED = ["request_id", "accepted", "rejected_seat"]


def request(number, seats, showtime=10, minute=0, name="Zoe", email="zoe@x.com"):
    body = None if seats is None else [(s, Decimal("250.00")) for s in seats]
    return (number, NOON + timedelta(minutes=minute), showtime, body, name, email, "card", money(250))


def frame(spark, requests):
    return spark.createDataFrame(requests, BOOKING_REQUESTS)


def one_by_one(requests, holds=()):
    """The rule in plain Python."""
    taken = {(h[1], h[2]) for h in holds if h[1] is not None}
    out = []
    for r in sorted(requests, key=lambda r: (r[1], r[0])):
        mine, rejected = set(), None
        for seat, _ in r[3] or []:
            if r[2] is not None and seat is not None:
                if (r[2], seat) in taken | mine:
                    rejected = seat
                    break
                mine.add((r[2], seat))
        accepted = r[3] is not None and rejected is None
        if accepted:
            taken |= mine
        out.append((r[0], accepted, rejected))
    return sorted(out, key=repr)


def random_requests(seed, n=400, showtimes=4, seats=25, hot=0.4):
    rng = random.Random(seed)
    out = []
    for number in range(n):
        show = 1 if rng.random() < hot else rng.randrange(1, showtimes + 1)
        wanted = [rng.randrange(seats) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5]))]
        out.append(request(number, wanted, show, rng.randrange(60)))
    return out


def test_first_come_all_or_nothing(spark):
    wanted = [(1, [1, 2]), (2, [2, 3]), (3, [3]), (4, [4, 4])]
    got = admission.admit_bookings(frame(spark, [request(n, s, minute=n) for n, s in wanted]))
    assert rows(got, *DECIDED) == [(1, True, None), (2, False, 2), (3, True, None), (4, False, 4)]


def test_loser_frees_its_seats_only_for_later_requests(spark):
    wanted = [(1, [1]), (2, [1, 2]), (3, [2, 3]), (4, [3, 1]), (5, [9, 2])]
    got = admission.admit_bookings(frame(spark, [request(n, s, minute=n) for n, s in wanted]))
    assert rows(got, *DECIDED) == [(1, True, None), (2, False, 1), (3, True, None), (4, False, 3), (5, False, 2)]


def test_nulls_never_conflict(spark):
    odd = [
        request(1, [5], None),
        request(2, [5], None),
        request(3, [], 10),
        request(4, [None, None], 10),
        request(5, None, 10),
        request(6, [None, 7, 7], 10),
        request(7, [5, 5], None),
    ]
    expected = one_by_one(odd)
    assert rows(admission.admit_bookings(frame(spark, odd)), *DECIDED) == expected
    assert dict((r, a) for r, a, _ in expected) == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_rule_applied_one_by_one(spark, seed):
    requests = random_requests(seed)
    holds = [hold(n, s, seat) for n, (s, seat) in enumerate([(1, 3), (1, 3), (2, 0), (None, 4), (3, None)])]
    got = rows(
        admission.admit_bookings(frame(spark, requests), spark.createDataFrame(holds, HOLDS)), *DECIDED
    )
    assert got == one_by_one(requests, holds)
    seat_of = {r[0]: [(r[2], s) for s, _ in r[3]] for r in requests}
    given = [slot for number, accepted, _ in got if accepted for slot in seat_of[number]]
    assert len(given) == len(set(given))


def test_chain_of_overlaps_in_one_hot_showtime(spark):
    """Every request overlaps the one before it: the longest chain of rounds."""
    chain = [request(n, [n, n + 1], minute=n) for n in range(12)]
    got = rows(admission.admit_bookings(frame(spark, chain)), *DECIDED)
    assert got == one_by_one(chain)


def test_split_partitions_do_not_split_a_showtime(spark, eager_skew_splitting):
    requests = random_requests(8, n=3000, showtimes=12, seats=150, hot=0.5)
    holds = [hold(n, n % 12 + 1, n) for n in range(60)]
    held = spark.createDataFrame(holds, HOLDS)
    wanted = frame(spark, requests).repartition(8).checkpoint()
    expected = one_by_one(requests, holds)
    assert rows(admission.admit_bookings(wanted, held), *DECIDED) == expected


def test_invalid_requests_take_nothing(spark, make_model):
    m = make_model(**BASE)
    odd = [
        request(1, [101], email=None),
        request(2, [101], 99),
        request(3, [101, 9999]),
        (4, NOON, 10, [(101, money(1))], "Zoe", "z@x.com", "card", None),
        request(5, None),
        request(6, [101, None], minute=1),
        request(7, [101], minute=2),
        request(8, [102], None),
        request(9, [], 99),
    ]
    got = admission.admit_bookings(frame(spark, odd), None, m["showtimes"], m["seats"])
    assert rows(got) == [
        (1, False, None, "NO_EMAIL"),
        (2, False, None, "UNKNOWN_SHOWTIME"),
        (3, False, None, "UNKNOWN_SEAT"),
        (4, False, None, "NO_AMOUNT"),
        (5, False, None, "NO_SEATS"),
        (6, True, None, None),
        (7, False, 101, "SEAT_TAKEN"),
        (8, True, None, None),
        (9, True, None, None),
    ]


def test_one_payment_for_a_doubled_email(spark, make_model):
    m = make_model(**{**BASE, "customers": [(5, "zoe@x.com", "Z"), (3, "zoe@x.com", "Zoe")]})
    wanted = frame(spark, [request(1, [101])])
    made = admission.booking_outputs(wanted, admission.admit_bookings(wanted), m)
    assert rows(made["payments"], "request_id", "customer_id") == [(1, 3)]


def test_expired_hold_blocks_unless_reuse_is_asked_for(spark):
    holds = spark.createDataFrame([hold(1, 10, 1, status="HELD", expires=NOON - timedelta(minutes=1))], HOLDS)
    wanted = frame(spark, [request(1, [1])])
    assert rows(admission.hold_seats(wanted, holds, NOON)["decisions"]) == [(1, False, 1, "SEAT_TAKEN")]
    people = spark.createDataFrame([(9, "zoe@x.com", "Zoe"), (4, "zoe@x.com", "Z")], OPERATIONAL["customers"])
    late = frame(spark, [request(1, [1], minute=3)])
    reused = admission.hold_seats(late, holds, NOON, reuse_expired=True, customers=people)
    assert rows(reused["decisions"]) == [(1, True, None, None)]
    row = reused["reservation_holds"].first()
    assert (row["status"], row["hold_expires_at"]) == ("HELD", NOON + timedelta(minutes=8))
    assert row["customer_id"] == 4


def test_a_hold_needs_neither_amount_nor_email(spark):
    holds = spark.createDataFrame([hold(1, 10, 1)], HOLDS)
    wanted = frame(spark, [request(1, [2]), request(2, [1]), request(3, [3])])
    bare = wanted.withColumns({c: F.lit(None).cast(wanted.schema[c].dataType) for c in ("payment_amount", "customer_email")})
    found = admission.hold_seats(bare, holds, NOON)
    assert rows(found["decisions"]) == [(1, True, None, None), (2, False, 1, "SEAT_TAKEN"), (3, True, None, None)]
    assert rows(found["reservation_holds"], "request_id", "seat_id", "customer_id") == [(1, 2, None), (3, 3, None)]
    assert rows(admission.admit_bookings(bare), "request_id", "accepted", "reason")[0] == (1, False, "NO_EMAIL")


def test_known_email_keeps_its_name_and_new_email_is_added_once(spark, make_model):
    existing = make_model(**BASE)["customers"]
    wanted = [
        request(1, [1], minute=2, name="Second", email="new@x.com"),
        request(2, [2], minute=1, name="First", email="new@x.com"),
        request(3, [3], name="Other", email="ann@x.com"),
        request(4, [3], name="Ann", email="Ann@x.com"),
    ]
    got = rows(upsert_customers(existing, frame(spark, wanted)), "email", "name", "is_new")
    assert got == [
        ("Ann@x.com", "Ann", True),
        ("ann@x.com", "Ann", False),
        ("bob@x.com", "Bob", False),
        ("new@x.com", "First", True),
    ]
    ids = [r["id"] for r in upsert_customers(existing, frame(spark, wanted)).collect()]
    assert len(ids) == len(set(ids))


def test_rows_of_accepted_requests(spark, make_model):
    m = make_model(**BASE, payments=[(40, 1, money(1), NOON, "CASH")],
                   reservation_holds=[hold(70, 12, 1)], tickets=[(90, 70, 40, money(1))])
    wanted = frame(spark, [request(1, [1, 2]), request(2, [2]), request(3, [4], email="ann@x.com")])
    made = admission.booking_outputs(wanted, admission.admit_bookings(wanted, m["reservation_holds"]), m)
    assert rows(made["customers"], "email") == [("zoe@x.com",)]
    assert rows(made["payments"], "request_id", "amount", "payment_method") == [
        (1, money(250), "card"),
        (3, money(250), "card"),
    ]
    holds = made["reservation_holds"].collect()
    assert {(h["showtime_id"], h["seat_id"], h["status"]) for h in holds} == {
        (10, s, "CONFIRMED") for s in (1, 2, 4)
    }
    assert all(h["hold_expires_at"] == NOON + timedelta(hours=1) and h["id"] > 70 for h in holds)
    tickets = made["tickets"].collect()
    assert {t["reservation_id"] for t in tickets} == {h["id"] for h in holds}
    assert {t["payment_id"] for t in tickets} == {p["id"] for p in made["payments"].collect()}
    assert len({t["id"] for t in tickets}) == 3 and min(t["id"] for t in tickets) > 90


def test_conflict_report(spark):
    wanted = frame(spark, [request(1, [1]), request(2, [1]), request(3, [1], 11), request(4, [2, 1])])
    decisions = admission.admit_bookings(wanted)
    assert rows(admission.conflict_report(wanted, decisions), "request_id", "details") == [
        (2, "Seat ID 1 is unavailable."),
        (4, "Seat ID 1 is unavailable."),
    ]
    assert rows(admission.conflicts_per_showtime(wanted, decisions)) == [(10, 2)]


def test_outputs_read_requests_once_and_number_lines_without_unfolding_them(spark, make_model):
    """New ids are unique and agree between the tables, also for requests that come twice."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        seen.add(1)
        return True

    m = make_model(**BASE)
    wanted = [request(n, [10 * n + i for i in range(n % 4)], email=f"{n % 3}@x.com") for n in range(1, 30)]
    wanted.append(wanted[2])
    decided = spark.createDataFrame([(n, True) for n in range(1, 30)], "request_id long, accepted boolean")
    made = admission.booking_outputs(frame(spark, wanted).filter(counted("customer_name")), decided, m)
    holds, tickets, payments = (made[n].collect() for n in ("reservation_holds", "tickets", "payments"))
    assert seen.value == len(wanted)
    lines = sum(len(w[3]) for w in wanted)
    assert len({h["id"] for h in holds}) == len({t["id"] for t in tickets}) == len(holds) == len(tickets) == lines
    assert {t["reservation_id"]: t["request_id"] for t in tickets} == {h["id"]: h["request_id"] for h in holds}
    assert len({p["id"] for p in payments}) == len(payments) == len(wanted)
    assert {t["payment_id"] for t in tickets} <= {p["id"] for p in payments}
    plan = made["tickets"]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_unknown_ids_are_looked_for_among_distinct_ones(spark, make_model):
    m = make_model(**BASE)
    odd = [request(n, [101, 9999 if n % 5 == 0 else 102], 99 if n % 7 == 0 else 10, minute=n) for n in range(1, 41)]
    found = admission._checked(frame(spark, odd), m["showtimes"], m["seats"], True)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    expected = {n: "UNKNOWN_SHOWTIME" if n % 7 == 0 else "UNKNOWN_SEAT" if n % 5 == 0 else None for n in range(1, 41)}
    assert dict(rows(found, "request_id", "reason")) == expected
