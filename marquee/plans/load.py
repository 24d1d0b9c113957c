"""The fact load as one job: read, publish, summarise, collect statistics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..operators.reports import REVENUE_DAYS, daily_revenue, etl_summary
from ..sinks.publish import publish
from ..sinks.tables import collect_table_stats
from ..sources.snapshots import Model, read_fact
from .fact import fact_bookings

#: Columns of the fact that single values are looked up by.
FACT_LOOKUPS = ("customer_id", "showtime_id", "movie_id")


def load_fact(spark: SparkSession, model: Model, path: str, table: str | None = None) -> DataFrame:
    """Build the fact of ``model``, publish it at ``path`` and return its summary.

    Readers of the version before finish on it.

    The summary reads what was published. With ``table`` the published files become that
    catalog table, with its partitions and column statistics.
    """
    version = publish(fact_bookings(model), path, lookup_by=FACT_LOOKUPS)
    if table is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.createTable(table, path=version, source="parquet")
        spark.catalog.recoverPartitions(table)
        collect_table_stats(spark, table)
    return etl_summary(read_fact(spark, path))


def recent_revenue(spark: SparkSession, path: str, as_of: date, days: int = REVENUE_DAYS) -> DataFrame:
    """Daily revenue over a published fact: only the months of the last ``days`` days are read."""
    return daily_revenue(read_fact(spark, path, as_of - timedelta(days=days)), as_of, days)
