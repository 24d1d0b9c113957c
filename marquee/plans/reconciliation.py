"""Source against fact: counts, daily totals, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import money_sum
from ..sources.snapshots import Model


def recon_counts(payments: DataFrame, fact: DataFrame) -> DataFrame:
    source = payments.agg(F.count(F.lit(1)).alias("source_count"))
    target = fact.agg(F.count(F.lit(1)).alias("fact_count")).scalar()
    return source.withColumn("fact_count", target).withColumn(
        "difference", F.col("source_count") - F.col("fact_count")
    )


def recon_payments_vs_fact(m: Model, fact: DataFrame) -> DataFrame:
    """Seats and revenue per day in the source and in the fact.

    Differences show payments that collapse into one fact row, payments counted once per
    showtime, and payments without tickets.
    """
    tickets = m["tickets"].groupBy(F.col("payment_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    source = (
        m["payments"]
        .join(tickets, "id", "left")
        .groupBy(F.to_date("payment_date").alias("day"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("source_seats"),
            money_sum("amount").alias("source_revenue"),
        )
    )
    loaded = fact.groupBy(F.col("booking_date").alias("day")).agg(
        F.sum("seats_booked").alias("fact_seats"), money_sum("total_revenue").alias("fact_revenue")
    )
    zero = F.lit(0).cast("decimal(20,2)")
    none = F.lit(0).cast("bigint")
    return source.join(loaded, "day", "full").select(
        "day",
        F.coalesce("source_seats", none).alias("source_seats"),
        F.coalesce("fact_seats", none).alias("fact_seats"),
        F.coalesce("source_revenue", zero).alias("source_revenue"),
        F.coalesce("fact_revenue", zero).alias("fact_revenue"),
        (F.coalesce("source_revenue", zero) - F.coalesce("fact_revenue", zero))
        .cast("decimal(20,2)")
        .alias("revenue_gap"),
    )


def feed_freshness(payments: DataFrame, fact: DataFrame) -> DataFrame:
    """How far the fact trails the newest source event."""
    newest = payments.agg(F.max("payment_date").alias("newest_source"))
    loaded = fact.agg(F.max("booking_timestamp").alias("m")).scalar()
    return newest.withColumn("newest_fact", loaded).withColumn(
        "lag_seconds", F.timestamp_diff("SECOND", F.col("newest_fact"), F.col("newest_source"))
    )
