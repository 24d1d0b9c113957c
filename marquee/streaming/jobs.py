"""Streaming versions of the fact load, daily revenue, seat claims, admission and expiry.

Every job works by micro-batch on what the batch touches. None has a watermark, so nothing that
comes late is lost. What jobs remember lies in stores whose runs grow with the logarithm of the
number of batches, and a batch reads the buckets of its own keys.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import ntz
from ..operators.admission import admit_bookings
from ..operators.seating import slot_first_claim
from .expiry import expire_batch
from .feed import read_all_changes, read_change_feed
from .follow import FactFollower, RevenueFollower, daily_revenue_of
from .slots import SLOT, begun, given_away, slot_store, without
from .store import BUCKETS

RELEASED = "showtime_id long, seat_id long, released_at timestamp_ntz"


def _state(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/state-of-job"


def _start(stream: DataFrame, checkpoint: str, run: Callable, available_now: bool) -> StreamingQuery:
    """Run ``run(batch, batch_id)`` on every micro-batch, read once."""

    def once(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            run(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_fact_bookings(
    spark: SparkSession,
    landing: str,
    fact_path: str,
    checkpoint: str,
    available_now: bool = False,
    files_per_trigger: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the fact up to date from the feed of all published tables.

    Rows may come in any order: tickets before their payment or hold, bookings before their
    customer, showtime, movie or auditorium. Changed and deleted rows of any table reach the fact.
    What the job remembers lies beside its checkpoint and goes with it.
    """
    follower = FactFollower(spark, _state(checkpoint), fact_path, buckets)
    changes = read_all_changes(spark, landing, files_per_trigger)
    return _start(changes, checkpoint, follower.apply, available_now)


def stream_daily_revenue(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    files_per_trigger: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Revenue per day, a table partitioned by day, kept up to date from the payment feed.

    A batch adds the differences that its payments make, however late they are.
    """
    follower = RevenueFollower(spark, _state(checkpoint), out, buckets)
    payments = read_change_feed(spark, landing, "payments", files_per_trigger)
    return _start(payments, checkpoint, follower.apply, available_now)


Clock = Callable[[], datetime]


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def claim_batch(
    batch: DataFrame, batch_id: int, out: str, showtimes: DataFrame | None = None, as_of: datetime | None = None
) -> None:
    """First claims of one micro-batch on slots that nobody has claimed before it.

    The claims of a batch are a folder of ``out``. With ``showtimes`` and ``as_of``, showtimes that
    have begun cannot be claimed, and their slots are forgotten.
    """
    over = begun(showtimes, as_of)
    store = slot_store(batch.sparkSession, f"{out}/_slots", over)
    claims = without(batch.dropna(subset=SLOT), over)
    first = slot_first_claim(claims).join(given_away(store, claims, batch_id), SLOT, "left_anti")
    path = f"{out}/batch_id={batch_id}"
    first.hint("rebalance").write.mode("overwrite").parquet(path)
    stored = batch.sparkSession.read.schema(first.schema).parquet(path)
    store.add(stored.select(*SLOT), batch_id)


def stream_first_claim(
    claims: DataFrame,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    showtimes: DataFrame | None = None,
    clock: Clock = _now,
) -> StreamingQuery:
    """First claim per slot from a stream of (showtime_id, seat_id, request_id, requested_at).

    Across micro-batches the earlier batch wins, inside one the earlier time, then id. A slot
    stays claimed for ever, or until its showtime begins where ``showtimes`` are given. Claims
    without a showtime or seat claim nothing.
    """
    return _start(claims, checkpoint, lambda b, i: claim_batch(b, i, out, showtimes, clock()), available_now)


def admit_batch(
    batch: DataFrame,
    batch_id: int,
    holds: DataFrame | None,
    out: str,
    as_of: datetime | None = None,
    **known: DataFrame | None,
) -> None:
    """Decide one micro-batch against all slots given away before it, and store the outcome.

    Decisions go to a folder of their own per batch; a replayed batch gives the same. With
    ``as_of`` those of the known showtimes that have begun are unknown to requests, and their
    slots are forgotten.
    """
    spark = batch.sparkSession
    over = begun(known.get("showtimes"), as_of)
    if over is not None:
        known["showtimes"] = known["showtimes"].filter(F.col("start_time") > ntz(as_of))
    store = slot_store(spark, f"{out}/slots", over)
    taken = given_away(store, batch, batch_id)
    if holds is not None:
        shows = batch.select("showtime_id").distinct()
        taken = taken.unionByName(holds.select(*SLOT).join(shows, "showtime_id", "left_semi"))
    decided = f"{out}/decisions/batch_id={batch_id}"
    admit_bookings(batch, taken, **known).write.mode("overwrite").parquet(decided)
    stored = spark.read.parquet(decided).filter("accepted")
    won = batch.join(stored.select("request_id"), "request_id", "left_semi")
    store.add(won.select("showtime_id", F.explode("seats.id").alias("seat_id")).dropna(), batch_id)


def stream_admit_bookings(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    holds: DataFrame | None = None,
    available_now: bool = False,
    clock: Clock | None = None,
    **known: DataFrame | None,
) -> StreamingQuery:
    """Admission over a request stream. The slots given away are the durable state; arrival
    decides between micro-batches, time and id inside one. ``known`` are the showtimes and seats
    that requests are held against; with a ``clock``, showtimes that have begun are over."""

    def run(batch: DataFrame, batch_id: int) -> None:
        admit_batch(batch, batch_id, holds, out, clock() if clock else None, **known)

    return _start(requests, checkpoint, run, available_now)


def stream_hold_expiry(
    holds: DataFrame,
    out: str,
    checkpoint: str,
    clock: Clock = _now,
    available_now: bool = False,
) -> StreamingQuery:
    """Seats released because their short hold ran out, from a stream of hold rows.

    Each micro-batch asks ``clock`` once for the time it stands for. The releases are the table
    ``released`` in ``out``.
    """
    return _start(holds, checkpoint, lambda b, i: expire_batch(b, i, out, clock()), available_now)
