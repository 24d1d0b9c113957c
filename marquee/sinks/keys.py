"""Surrogate keys without a global row number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BUCKETS = 1 << 16
# Keys of one value of ``within``: room for 16 million rows in each bucket.
RANGE = 1 << 40


def with_surrogate_key(
    df: DataFrame,
    unique_by: Sequence[str],
    name: str = "id",
    start: int | Column = 1,
    buckets: int = KEY_BUCKETS,
    within: Column | None = None,
    items: tuple[str, Column] | None = None,
) -> DataFrame:
    """Add a unique whole-number key to rows that are distinct on ``unique_by``.

    Rows are numbered inside hash buckets and the numbers interleaved, so the key is exactly
    unique (a plain 64-bit hash would collide at some billions of rows), repeatable, and no
    task ever sees more than one bucket's share of the rows. Like a sequence it may have gaps.

    ``within`` gives every one of its values, whole numbers from 0, a range of RANGE keys of its
    own: rebuilding the rows of one value gives the same keys and none of another's.

    ``items`` (name, how many a row has) adds the key from 0 of a row's first item; those of the
    next ones are ``buckets`` apart. No row per item is needed for it.
    """
    bucket = F.pmod(F.xxhash64(*unique_by), F.lit(buckets))
    first = F.lit(start) if isinstance(start, int) else start
    part = F.lit(0) if within is None else within
    order = Window.partitionBy("_part", "_bucket").orderBy(*unique_by)
    position = (F.row_number().over(order) - 1).cast("bigint")
    key = F.col("_part") * F.lit(RANGE) + first.cast("bigint") + position * F.lit(buckets) + F.col("_bucket")
    keys = {name: key}
    if items is not None:
        before = F.sum(items[1].cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        keys[items[0]] = F.col("_part") * F.lit(RANGE) + F.coalesce(before, F.lit(0)) * F.lit(buckets) + F.col("_bucket")
    return (
        df.withColumn("_part", part.cast("bigint"))
        .withColumn("_bucket", bucket)
        .withColumns(keys)
        .drop("_part", "_bucket")
    )
