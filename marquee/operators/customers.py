"""Get-or-create of customers by e-mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.keys import with_surrogate_key


def new_customers(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Customers that requests bring in: one per unknown e-mail, named by its first request."""
    known = existing.select(F.col("email").alias("customer_email"))
    first = F.min(F.struct("requested_at", "request_id", "customer_name")).alias("first")
    fresh = (
        requests.dropna(subset=["customer_email"])
        .groupBy("customer_email")
        .agg(first)
        .join(known, "customer_email", "left_anti")
        .select(
            F.col("customer_email").alias("email"), F.col("first.customer_name").alias("name")
        )
    )
    start = F.coalesce(existing.agg(F.max("id").alias("m")).scalar(), F.lit(0)) + 1
    return with_surrogate_key(fresh, ["email"], "id", start).select("id", "email", "name")


def upsert_customers(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """All customers after the requests. E-mails match exactly and names never change."""
    return (
        existing.select("id", "email", "name", F.lit(False).alias("is_new"))
        .unionByName(new_customers(existing, requests).withColumn("is_new", F.lit(True)))
    )
