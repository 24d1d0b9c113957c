"""Distribution reports over payments and tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_type, slot4
from ..functions.numeric import money_sum, percent_of


def share_of_total(df: DataFrame, count: str, name: str = "pct") -> DataFrame:
    """Add each row's count in percent of the sum of all counts.

    The total is a scalar subquery over the same aggregate, so no window has to pull all
    groups into one task; the shuffle below is planned once and shared.
    """
    total = df.agg(F.sum(count).alias("t")).scalar()
    return df.withColumn(name, percent_of(count, total))


def booking_stats(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.count(F.lit(1)).alias("bookings"),
        F.countDistinct("customer_id").alias("customers"),
        money_sum("amount").alias("revenue"),
    )


def seats_per_booking(tickets: DataFrame) -> DataFrame:
    """How many bookings have how many seats."""
    sizes = tickets.groupBy("payment_id").agg(F.count(F.lit(1)).alias("seat_count"))
    counts = sizes.groupBy("seat_count").agg(F.count(F.lit(1)).alias("bookings"))
    return share_of_total(counts, "bookings").orderBy("seat_count")


def slot_distribution(payments: DataFrame) -> DataFrame:
    hour = F.hour("payment_date")
    counts = payments.groupBy(slot4(hour).alias("slot")).agg(
        F.count(F.lit(1)).alias("bookings"), F.min(hour).alias("first_hour")
    )
    return share_of_total(counts, "bookings").orderBy("first_hour").drop("first_hour")


def day_type_distribution(payments: DataFrame) -> DataFrame:
    counts = payments.groupBy(day_type("payment_date").alias("type")).agg(
        F.count(F.lit(1)).alias("bookings")
    )
    return share_of_total(counts, "bookings")


def repeat_rate(payments: DataFrame) -> DataFrame:
    """Customers with more than one payment. After grouping, customers are distinct."""
    per_customer = payments.groupBy("customer_id").agg(F.count(F.lit(1)).alias("b"))
    totals = per_customer.agg(
        F.count("customer_id").alias("total"),
        F.count(F.when(F.col("b") > 1, F.col("customer_id"))).alias("repeats"),
    )
    return totals.withColumn("pct", percent_of("repeats", "total"))
