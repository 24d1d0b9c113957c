"""Stores between micro-batches: few runs, replays, retirement, and the wheel of open holds."""

from __future__ import annotations

import random
from datetime import timedelta

from cinema import NOON, hold
from frames import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators import seating
from marquee.sinks import files
from marquee.sources.schemas import OPERATIONAL
from marquee.streaming import expiry, jobs
from marquee.streaming.slots import begun, given_away, slot_store
from marquee.streaming.store import RunStore, hashed

SUMS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def added(rows_):
    return rows_.groupBy("key").agg(F.sum("n").alias("n"))


def test_runs_and_listings_stay_level(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "sums"), SUMS, hashed("key", buckets=2), added, fan=3)
    draw, expected = random.Random(1), {}
    for batch in range(40):
        part = [(draw.randrange(6), draw.randrange(9)) for _ in range(4)]
        for key, n in part:
            expected[key] = expected.get(key, 0) + n
        df = spark.createDataFrame(part, SUMS).coalesce(1)
        store.add(df, batch)
        if batch % 13 == 5:
            store.add(df, batch)  # runs again
        # two runs a level at most, four levels for 40 batches; two manifests
        assert len(store.runs(batch + 1)) <= 8
        assert len(files.children(spark, f"{store.path}/manifests")) <= 2
        assert len(files.children(spark, f"{store.path}/runs")) <= 16
    assert dict(rows(store.read(40))) == expected
    key = spark.createDataFrame([(3,)], "key long")
    assert rows(store.find(40, key)) == [(3, expected[3])]
    assert store.find(0, key).count() == 0


def test_slots_of_begun_showtimes_are_forgotten(spark, tmp_path):
    shows = spark.createDataFrame(
        [(n, 1, 1, NOON + timedelta(hours=n)) for n in range(4)], OPERATIONAL["showtimes"]
    )
    path = str(tmp_path / "slots")
    for batch in range(9):
        over = begun(shows, NOON + timedelta(hours=2, minutes=30)) if batch == 7 else None
        slots = spark.createDataFrame([(n, batch) for n in range(4)], "showtime_id long, seat_id long")
        slot_store(spark, path, over, buckets=2).add(slots.coalesce(1), batch)
    left = slot_store(spark, path, buckets=2)
    everyone = spark.createDataFrame([(n,) for n in range(4)], "showtime_id long")
    kept = rows(given_away(left, everyone, 9))
    assert {s for n, s in kept if n == 3} == set(range(9))
    assert {n for n, s in kept if s < 8} == {3}  # folded runs hold nothing of the begun ones


def test_begun_showtimes_cannot_be_claimed(spark, tmp_path):
    schema = "showtime_id long, seat_id long, request_id long, requested_at timestamp"
    shows = spark.createDataFrame([(1, 1, 1, NOON), (2, 1, 1, NOON + timedelta(hours=3))], OPERATIONAL["showtimes"])
    out = str(tmp_path / "out")
    for number, claims in enumerate([[(1, 1, 1, NOON), (2, 1, 2, NOON), (9, 1, 3, NOON)], [(2, 1, 4, NOON), (2, 2, 5, NOON)]]):
        jobs.claim_batch(spark.createDataFrame(claims, schema), number, out, shows, NOON + timedelta(minutes=1))
    assert rows(spark.read.parquet(out), "showtime_id", "seat_id", "request_id") == [(2, 1, 2), (2, 2, 5), (9, 1, 3)]


def test_random_holds_on_the_wheel(spark, tmp_path):
    """Releases equal those of the batch rule, through days, renewals, sales and replays."""
    draw, out, everything = random.Random(3), str(tmp_path / "out"), []
    minute = 0
    for batch in range(6):
        minute += draw.choice([1, 4, 30, 3000])
        now = NOON + timedelta(minutes=minute)
        part = []
        for n in range(12):
            status = draw.choice(["HELD", "HELD", "HELD", "BOOKED", "CONFIRMED"])
            ends = minute + draw.choice([-50, 1, 3, 5, 90, 5000])
            part.append(hold(100 * batch + n, draw.randrange(3), draw.randrange(14), status=status, expires=NOON + timedelta(minutes=ends)))
        everything += part
        df = spark.createDataFrame(part, OPERATIONAL["reservation_holds"]).coalesce(1)
        for _ in range(2 if batch == 3 else 1):
            expiry.expire_batch(df, batch, out, now, buckets=2)
    # nothing but the clock: all that is open comes due
    now += timedelta(days=30)
    none = spark.createDataFrame([], OPERATIONAL["reservation_holds"])
    expiry.expire_batch(none, 6, out, now, buckets=2)
    wheel = RunStore(spark, f"{out}/wheel", expiry.WHEEL, F.lit(0), lambda r: r)
    assert wheel.buckets(7) == []
    holds = spark.createDataFrame(everything, OPERATIONAL["reservation_holds"])
    final = expiry.released_until(spark, out).groupBy("showtime_id", "seat_id").agg(F.max("released_at").alias("released_at"))
    settled = holds.filter("status <> 'HELD'").select("showtime_id", "seat_id").distinct()
    never_sold = final.join(settled, ["showtime_id", "seat_id"], "left_anti")
    assert rows(never_sold) == rows(seating.released_holds(holds, now).select("showtime_id", "seat_id", "released_at"))


def test_a_batch_reads_only_what_is_due(spark, tmp_path):
    out = str(tmp_path / "out")
    later = [hold(n, n, n, status="HELD", expires=NOON + timedelta(minutes=10 * n)) for n in range(1, 9)]
    expiry.expire_batch(spark.createDataFrame(later, OPERATIONAL["reservation_holds"]), 0, out, NOON, buckets=2)
    wheel = RunStore(spark, f"{out}/wheel", expiry.WHEEL, F.lit(0), lambda r: r)
    assert len(wheel.buckets(1)) == 8
    none = spark.createDataFrame([], OPERATIONAL["reservation_holds"])
    expiry.expire_batch(none, 1, out, NOON + timedelta(minutes=21), buckets=2)
    assert len(wheel.buckets(2)) == 6
    assert rows(expiry.released_until(spark, out), "seat_id") == [(1,), (2,)]
