"""The fact and the daily revenue that follow a feed equal those of its current rows."""

from __future__ import annotations

import random
from datetime import timedelta

from cinema import BASE, NOON, at, hold, money
from frames import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.plans.fact import FACT_COLUMNS, fact_bookings
from marquee.sources.schemas import CHANGE, FACT_BOOKINGS, OPERATIONAL
from marquee.sources.snapshots import current_rows
from marquee.streaming.feed import PUBLISHED, of_table
from marquee.streaming.follow import FactFollower, RevenueFollower, daily_revenue_of

BUCKETS = 2


class Feed:
    """Batches of (table, row, kind, version), applied and compared with the batch operators."""

    def __init__(self, spark, folder):
        self.spark, self.number = spark, 0
        self.fact, self.days = f"{folder}/fact", f"{folder}/days"
        self.follower = FactFollower(spark, f"{folder}/state", self.fact, BUCKETS)
        self.revenue = RevenueFollower(spark, f"{folder}/revenue", self.days, BUCKETS)
        self.history = {name: [] for name in PUBLISHED}

    def frames(self, changes):
        """The batch as ``read_all_changes`` gives it, from a list."""
        batch = None
        for name in PUBLISHED:
            schema = T.StructType([*OPERATIONAL[name].fields, *CHANGE.fields, T.StructField("table", T.StringType())])
            part = [(*row, kind, version, name) for table, row, kind, version in changes if table == name]
            df = self.spark.createDataFrame(part, schema)
            batch = df if batch is None else batch.unionByName(df, allowMissingColumns=True)
        return batch.coalesce(1)

    def apply(self, *changes, replay=False):
        for table, row, kind, version in changes:
            self.history[table].append((*row, kind, version))
        batch = self.frames(changes).persist()
        for _ in range(2 if replay else 1):
            self.follower.apply(batch, self.number)
            self.revenue.apply(of_table(batch, "payments"), self.number)
        batch.unpersist()
        self.number += 1

    def model(self):
        out = {}
        for name, history in self.history.items():
            schema = T.StructType([*OPERATIONAL[name].fields, *CHANGE.fields])
            out[name] = current_rows(self.spark.createDataFrame(history, schema).coalesce(1))
        return out

    def check(self):
        m = self.model()
        expected = rows(fact_bookings(m).select(*FACT_COLUMNS))
        found = rows(self.spark.read.schema(FACT_BOOKINGS).option("basePath", self.fact).parquet(self.fact).select(*FACT_COLUMNS))
        assert found == expected
        days = daily_revenue_of(m["payments"])
        assert rows(self.spark.read.parquet(self.days).select(*days.columns)) == rows(days)
        return found


def first_copy(**tables):
    return [(name, row, None, None) for name, part in tables.items() for row in part]


def bookings():
    return dict(
        payments=[(n, 1 + n % 2, money(100 * n), at(f"2025-1{n}-01 10:00:00"), "CASH") for n in (0, 1, 2)],
        reservation_holds=[hold(n, 10 + n % 3, 100 + n) for n in (1, 2, 3, 4)],
        tickets=[(1, 1, 0, money(1)), (2, 2, 1, money(1)), (3, 3, 2, money(1)), (4, 4, 2, money(1))],
    )


MASTERS = {n: BASE[n] for n in ("customers", "movies", "auditoriums", "showtimes")}
UPDATES = [
    ("movies", (1, "Crimson", 101, money(260)), "UPDATE", 1),
    ("auditoriums", (2, "Grand Hall", 200), "UPDATE", 2),
    ("showtimes", (11, 2, 2, at("2025-11-08 15:30:00")), "UPDATE", 3),
    ("customers", (2, "bob@y.com", "Robert"), "UPDATE", 4),
]


def test_updates_of_each_dimension(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.apply(*first_copy(**MASTERS, **bookings()))
    before = feed.check()
    for changes, replay in ((UPDATES[:1], True), (UPDATES[1:2], False), (UPDATES[2:], False)):
        feed.apply(*changes, replay=replay)
        after = feed.check()
        assert after != before
        before = after
    assert {r[5] for r in before} == {"Crimson", "Blue"} and {r[11] for r in before} == {"Cinema 1", "Grand Hall"}


def test_parents_that_come_last(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    tables = bookings()
    feed.apply(*first_copy(tickets=tables["tickets"], showtimes=MASTERS["showtimes"]))
    feed.apply(*first_copy(payments=tables["payments"], customers=MASTERS["customers"][:1], movies=MASTERS["movies"]))
    feed.apply(*first_copy(reservation_holds=tables["reservation_holds"], auditoriums=MASTERS["auditoriums"][:1]))
    feed.check()
    feed.apply(*first_copy(customers=MASTERS["customers"][1:], auditoriums=MASTERS["auditoriums"][1:]))
    # The payments to showtimes 10, 11 and 12; that of the last day has seats for two showtimes.
    assert len(feed.check()) == 4


def test_everything_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.apply(*first_copy(**MASTERS, **bookings()))
    feed.apply(("showtimes", (10, None, None, None), "DELETE", 1))
    feed.check()
    feed.apply(*[("payments", (n, None, None, None, None), "DELETE", 2 + n) for n in (0, 1, 2)])
    m = feed.model()
    assert fact_bookings(m).count() == 0 and spark.read.schema(FACT_BOOKINGS).parquet(feed.fact).count() == 0


def random_change(draw, version):
    kind = draw.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
    table = draw.choice(["payments", "payments", "tickets", "tickets", "reservation_holds", "customers", "movies", "showtimes", "auditoriums"])
    key = draw.randrange(1, 9)
    when = NOON + timedelta(days=draw.randrange(-70, 70))
    row = {
        "payments": (key, draw.randrange(1, 4), draw.choice([money(100), money(250), None]), draw.choice([when, when, None]), "CASH"),
        "tickets": (key, draw.randrange(1, 9), draw.randrange(1, 9), money(1)),
        "reservation_holds": hold(key, draw.randrange(10, 14), 100 + key),
        "customers": (key % 4, f"c{version}@x.com", f"C{version}"),
        "movies": (key % 3, f"M{version}", 100, money(version)),
        "showtimes": (10 + key % 4, draw.randrange(1, 3), draw.randrange(1, 3), when),
        "auditoriums": (key % 3, f"H{version}", 200),
    }[table]
    if kind == "DELETE":
        row = (row[0], *[None] * (len(row) - 1))  # the key alone
    return table, row, kind, version


def test_random_feed(spark, tmp_path):
    draw = random.Random(1)
    feed = Feed(spark, tmp_path)
    feed.apply(*first_copy(**MASTERS, **bookings()))
    version = 1
    for round_ in range(2):
        changes = []
        for _ in range([25, 9][round_]):
            changes.append(random_change(draw, version))
            version += 1
        draw.shuffle(changes)  # versions decide, not the order
        feed.apply(*changes, replay=round_ == 1)
        feed.check()


def test_untouched_payments_are_not_read(spark, tmp_path):
    """A batch reads the buckets of its own keys; a payment elsewhere may even be unreadable."""
    feed = Feed(spark, tmp_path)
    feed.follower = FactFollower(spark, f"{tmp_path}/many", feed.fact, 50)
    payments = [(n, 1, money(n), at("2025-11-01 10:00:00"), "CASH") for n in range(1, 40)]
    tables = dict(
        payments=payments,
        reservation_holds=[hold(n, 10, n) for n in range(1, 40)],
        tickets=[(n, n, n, money(1)) for n in range(1, 40)],
    )
    feed.apply(*first_copy(**MASTERS, **tables))
    store = feed.follower.tables["payments"].store
    one = spark.createDataFrame([(7,)], "id long")
    found = store.find(1, one)
    assert [r.amount for r in found.collect()] == [money(7)]
    assert len(found.inputFiles()) == 1 < len(store.folders(1))
    feed.apply(("payments", (7, 1, money(1000), at("2025-12-01 10:00:00"), "CASH"), "UPDATE", 1))
    feed.check()


def test_a_batch_is_derived_once(spark, tmp_path):
    """Each table of a batch is evaluated once and stored once, under the keys that later batches ask for."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        seen.add(1)
        return True

    def part(name, table):
        schema = T.StructType([*OPERATIONAL[name].fields, *CHANGE.fields])
        df = spark.createDataFrame([(*row, None, None) for row in table], schema).coalesce(1)
        return df.filter(counted("id")).withColumn("table", F.lit(name))

    tables = bookings()
    batch = part("tickets", tables["tickets"]).unionByName(part("payments", tables["payments"]), allowMissingColumns=True)
    follower = FactFollower(spark, f"{tmp_path}/state", f"{tmp_path}/fact", BUCKETS)
    follower.apply(batch, 0)
    assert seen.value == len(tables["tickets"]) + len(tables["payments"])
    assert not follower.links.store.folders(1)  # tickets are found by reservation, seats by payment
    assert rows(follower.reserved.read(1)) == [(n, p, 1) for n, p in ((1, 0), (2, 1), (3, 2), (4, 2))]


def test_late_holds_moved_tickets_and_old_versions(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    tables = bookings()
    holds = tables.pop("reservation_holds")
    feed.apply(*first_copy(**MASTERS, **tables, reservation_holds=holds[:2]))
    feed.apply(
        *first_copy(reservation_holds=holds[2:]),
        ("tickets", (1, 3, 1, money(1)), "UPDATE", 5),  # to a hold of this batch and another payment
        ("payments", (1, 2, money(7), at("2025-12-09 10:00:00"), "CASH"), "UPDATE", 5),
        ("reservation_holds", hold(2, 10, 102), "UPDATE", 5),
    )
    feed.check()
    feed.apply(
        ("tickets", (1, 1, 0, money(1)), "UPDATE", 4),  # older than what is known
        ("reservation_holds", hold(2, 11, 102), "DELETE", 4),
        ("payments", (2, 1, None, None, "CASH"), "UPDATE", 6),  # no longer dated
    )
    # tickets 1 and 2, both with payment 1 and showtime 10
    assert [r[FACT_COLUMNS.index("seats_booked")] for r in feed.check()] == [2]
