"""Constraint checks the operational database enforces, as reports over snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import money_sum
from ..sources.schemas import FOREIGN_KEYS, NOT_NULL, TEXT_LIMITS, UNIQUE_KEYS
from ..sources.snapshots import Model


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _count_per_column(df: DataFrame, table: str, broken: Mapping[str, object]) -> DataFrame:
    """One pass over a table: number of rows for which each column's test holds."""
    counts = df.agg(*[F.count_if(test).alias(column) for column, test in broken.items()])
    cells = [
        F.struct(F.lit(column).alias("column_name"), F.col(column).alias("violations"))
        for column in broken
    ]
    return counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*cells)))


def integrity_not_null(m: Model, columns: Mapping[str, list[str]] = NOT_NULL) -> DataFrame:
    """Nulls per table and column that must not be null."""
    return _union(
        _count_per_column(m[table], table, {c: F.col(c).isNull() for c in names})
        for table, names in columns.items()
        if table in m
    )


def integrity_text_length(m: Model) -> DataFrame:
    """Texts longer than their column allows."""
    return _union(
        _count_per_column(m[table], table, {c: F.length(c) > n for c, n in limits.items()})
        for table, limits in TEXT_LIMITS.items()
        if table in m
    )


def integrity_unique(m: Model) -> DataFrame:
    """Key values that occur more than once. Null keys never collide."""

    def repeated(table: str, keys: list[str]) -> DataFrame:
        counts = m[table].dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        return counts.filter("copies > 1").select(
            F.lit(f"{table}({','.join(keys)})").alias("constraint_name"),
            text.alias("key_value"),
            "copies",
        )

    return _union(repeated(table, keys) for table, keys in UNIQUE_KEYS if table in m)


def integrity_foreign_keys(m: Model) -> DataFrame:
    """Rows per foreign key that point nowhere.

    References are counted per value before the join, so a value shared by very many rows
    is one row by then. They lie by value already, so only the parents are shuffled for the join;
    none is sent whole through the driver.
    """

    def orphans(table: str, column: str, parent: str) -> DataFrame:
        used = m[table].dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        parents = m[parent].select(F.col("id").alias(column))
        return used.join(parents.hint("merge"), column, "left_anti").agg(
            F.lit(f"{table}.{column}->{parent}").alias("constraint_name"),
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("orphans"),
        )

    return _union(orphans(*key) for key in FOREIGN_KEYS if key[0] in m and key[2] in m)


def double_bookings(holds: DataFrame) -> DataFrame:
    """Slots held more than once."""
    counts = holds.groupBy("showtime_id", "seat_id").agg(F.count(F.lit(1)).alias("booking_count"))
    return counts.filter("booking_count > 1")


def payments_without_tickets(m: Model) -> DataFrame:
    """Payments the fact load drops because no ticket refers to them.

    ``distinct`` folds a payment with very many tickets before the shuffle the join needs anyway.
    """
    ticketed = m["tickets"].select(F.col("payment_id").alias("id")).distinct()
    return m["payments"].join(ticketed, "id", "left_anti")


def payment_amount_mismatch(m: Model) -> DataFrame:
    """Payments whose amount is not the sum of their ticket prices."""
    prices = (
        m["tickets"]
        .groupBy("payment_id")
        .agg(money_sum("price").alias("ticket_total"), F.count(F.lit(1)).alias("tickets"))
    )
    paid = m["payments"].select(F.col("id").alias("payment_id"), "amount")
    return paid.join(prices, "payment_id").filter(F.col("amount") != F.col("ticket_total"))
