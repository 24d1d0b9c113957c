"""Short holds on a wheel: open holds lie by their time of expiry, and a batch reads what is due.

An entry of the wheel is a slot and an expiry. Entries are not taken off the wheel when a hold is
renewed or sold; when one comes due, the state of its slot tells whether it still counts. States
are kept by showtime, so a batch reads those of its due entries alone.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ntz
from .slots import SLOT
from .store import BUCKETS, RunStore, hashed

#: Seconds of a notch of the wheel, and how far notches reach; later expiries lie by the day.
NOTCH, REACH, DAY = 300, 86_400, 86_400
_ENTRY = [
    T.StructField("showtime_id", T.LongType()),
    T.StructField("seat_id", T.LongType()),
    T.StructField("expires", T.TimestampNTZType()),
]
WHEEL = T.StructType(_ENTRY)
STATE = T.StructType(
    [*_ENTRY, T.StructField("settled", T.BooleanType()), T.StructField("released_at", T.TimestampNTZType())]
)


def _notch(now: int) -> Column:
    """Bucket of an expiry: its notch, or for later ones minus its day."""
    seconds = F.col("expires").cast("timestamp").cast("long")
    near = F.floor(seconds / NOTCH)
    return F.when(seconds <= now + REACH, near).otherwise(-F.floor(seconds / DAY)).cast("long")


def _may_be_due(bucket: int, now: int) -> bool:
    return -bucket * DAY <= now + REACH if bucket < 0 else bucket * NOTCH <= now


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SLOT).agg(F.max("expires").alias("expires"))


def _states(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SLOT).agg(
        F.max("expires").alias("expires"), F.max("settled").alias("settled"), F.max("released_at").alias("released_at")
    )


def expire_batch(
    batch: DataFrame, batch_id: int, out: str, as_of: datetime, buckets: int = BUCKETS
) -> None:
    """Release the seats whose short holds have run out by ``as_of``.

    ``batch`` are new hold rows. A hold that is sold, in this batch or before, is never released;
    a renewed hold runs until its latest expiry; the same expiry is released once. Releases go to
    a folder of their own per batch, so a batch that runs again gives the same table.
    """
    spark = batch.sparkSession
    now = int(as_of.replace(tzinfo=UTC).timestamp())
    wheel = RunStore(spark, f"{out}/wheel", WHEEL, _notch(now), _latest)
    states = RunStore(spark, f"{out}/states", STATE, hashed("showtime_id", buckets=buckets), _states)
    over = F.col("expires") <= ntz(as_of)

    rows = batch.dropna(subset=SLOT)
    held = rows.filter("status = 'HELD'").select(*SLOT, F.col("hold_expires_at").alias("expires"))
    held = _latest(held.dropna())
    sold = rows.filter("status <> 'HELD'").select(*SLOT).distinct()
    fresh = _new_states(held, sold)

    turned = [b for b in wheel.buckets(batch_id) if _may_be_due(b, now)]
    entries = wheel.read(batch_id, turned).unionByName(held) if turned else held
    due = entries.filter(over).distinct()
    keys = due.select(*SLOT).distinct()
    known = states.find(batch_id, keys).unionByName(fresh.join(keys, SLOT, "left_semi"))
    state = _states(known).withColumnRenamed("expires", "latest")
    released = (
        due.join(state, SLOT)
        .filter(~F.col("settled") & (F.col("expires") == F.col("latest")))
        .filter(F.col("released_at").isNull() | (F.col("released_at") < F.col("expires")))
        .select(*SLOT, F.col("expires").alias("released_at"))
    )
    path = f"{out}/released/batch_id={batch_id}"
    released.hint("rebalance").write.mode("overwrite").parquet(path)
    stored = spark.read.schema(released.schema).parquet(path)
    none = F.lit(None).cast("timestamp_ntz")
    ended = stored.select(*SLOT, none.alias("expires"), F.lit(False).alias("settled"), "released_at")
    states.add(_states(fresh.unionByName(ended)), batch_id)
    wheel.add(entries.filter(~over), batch_id, drop=turned)


def _new_states(held: DataFrame, sold: DataFrame) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    open_ones = held.select(*SLOT, "expires", F.lit(False).alias("settled"), none.alias("released_at"))
    return open_ones.unionByName(
        sold.select(*SLOT, none.alias("expires"), F.lit(True).alias("settled"), none.alias("released_at"))
    )


def released_until(spark: SparkSession, out: str) -> DataFrame:
    """All releases so far: showtime_id, seat_id, released_at."""
    return spark.read.schema("showtime_id long, seat_id long, released_at timestamp_ntz").parquet(f"{out}/released")
