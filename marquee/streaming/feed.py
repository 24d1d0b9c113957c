"""Change feed of the operational tables: a landing folder per table, first copy included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.files import make_folder
from ..sources.schemas import BOOKING_REQUESTS, CHANGE, OPERATIONAL

# Published tables; seats never change and are not part of the feed.
PUBLISHED = [name for name in OPERATIONAL if name != "seats"]


def read_change_feed(
    spark: SparkSession, landing: str, table: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the rows of one table. Files already there are the first copy, new files the
    changes: inserts, updates and deletions, told by the CHANGE columns (null in a first copy)."""
    if table == "booking_requests":
        schema = BOOKING_REQUESTS
    else:
        schema = T.StructType([*OPERATIONAL[table].fields, *CHANGE.fields])
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{landing.rstrip('/')}/{table}")


def read_all_changes(
    spark: SparkSession, landing: str, files_per_trigger: int | None = None
) -> DataFrame:
    """One stream of the rows of all published tables, told apart by the column ``table``; columns
    that a table does not have are null. Folders that have not been landed yet are made."""
    changes = None
    for name in PUBLISHED:
        make_folder(spark, f"{landing.rstrip('/')}/{name}")
        rows = read_change_feed(spark, landing, name, files_per_trigger)
        rows = rows.withColumn("table", F.lit(name))
        changes = rows if changes is None else changes.unionByName(rows, allowMissingColumns=True)
    return changes


def of_table(changes: DataFrame, name: str) -> DataFrame:
    """The rows of one table of ``read_all_changes``."""
    columns = [*OPERATIONAL[name].fieldNames(), *CHANGE.fieldNames()]
    return changes.filter(F.col("table") == name).select(*columns)
