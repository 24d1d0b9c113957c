"""Slots that are given away, for jobs that must remember them until nobody can want them.

A slot is kept in a store by showtime; a batch reads the buckets of its own showtimes. Where the
showtimes are known, slots of those that have begun are forgotten when runs are folded.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ntz
from .store import BUCKETS, RunStore, hashed

SLOT = ["showtime_id", "seat_id"]
_SLOTS = T.StructType([T.StructField(c, T.LongType()) for c in SLOT])


def begun(showtimes: DataFrame | None, as_of: datetime | None) -> DataFrame | None:
    """Showtimes that nobody can book any more."""
    if showtimes is None or as_of is None:
        return None
    return showtimes.filter(F.col("start_time") <= ntz(as_of)).select(F.col("id").alias("showtime_id")).distinct()


def without(rows: DataFrame, over: DataFrame | None) -> DataFrame:
    return rows if over is None else rows.join(over, "showtime_id", "left_anti")


def slot_store(
    spark: SparkSession, path: str, over: DataFrame | None = None, buckets: int = BUCKETS
) -> RunStore:
    """Store of (showtime_id, seat_id) that forgets the slots of the showtimes ``over``."""
    return RunStore(
        spark, path, _SLOTS, hashed("showtime_id", buckets=buckets), lambda rows: without(rows.distinct(), over)
    )


def given_away(store: RunStore, wanted: DataFrame, before: int) -> DataFrame:
    """Slots given away before a batch in the showtimes of ``wanted``."""
    return store.find(before, wanted.select("showtime_id").dropna().distinct())
