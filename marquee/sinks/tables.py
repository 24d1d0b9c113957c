"""Table writes: full refresh, idempotent append, defaults, statistics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_full_refresh(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("year", "month_num"),
    sort_by: Sequence[str] = ("booking_date", "movie_id"),
) -> None:
    """Replace the table at ``path``; a failed run leaves the old table in place.

    The result is written next to the table and moved in only when complete. Rows are spread by
    partition and date before writing, so that a month is a few well-sized files whose footers
    let later scans skip row groups by date; AQE splits a month too big for one task.
    """
    spark = df.sparkSession
    out = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    out = out.sortWithinPartitions(*partition_by, *sort_by) if sort_by else out
    staged = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    out.write.partitionBy(*partition_by).parquet(staged)
    _move_into_place(spark, staged, path)


def _move_into_place(spark: SparkSession, staged: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    retired = jvm.org.apache.hadoop.fs.Path(f"{staged}__old")
    had_table = fs.exists(target)
    if had_table and not fs.rename(target, retired):
        raise OSError(f"cannot retire {path}")
    if not fs.rename(source, target):
        if had_table:
            fs.rename(retired, target)
        raise OSError(f"cannot publish {path}")
    if had_table:
        fs.delete(retired, True)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], spread: bool = False) -> None:
    """Replace only the partitions present in ``df``; running it twice changes nothing. Rows are
    ``spread`` by partition or will be, so that each is a few well-sized files."""
    (
        (df if spread else df.hint("rebalance", *[F.col(c) for c in partition_by]))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not yet in ``existing``, one per key.

    ``min`` of the whole row combines before the shuffle and decides repeatably which of
    several copies stays. Rows with a null key never count as duplicates of each other.
    """
    rest = [c for c in incoming.columns if c not in keys]
    keyed = incoming.dropna(subset=list(keys))
    if rest:
        kept = (
            keyed.groupBy(*keys)
            .agg(F.min(F.struct(*rest)).alias("_row"))
            .select(*keys, "_row.*")
            .select(*incoming.columns)
        )
    else:
        kept = keyed.distinct()
    known = existing.select(*keys).distinct()
    fresh = kept.join(known, list(keys), "left_anti").select(*incoming.columns)
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    return fresh.unionByName(incoming.filter(has_null))


def append_ignore_duplicates(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``existing`` plus the rows of ``incoming`` that bring a new key."""
    return existing.unionByName(new_rows(existing, incoming, keys).select(*existing.columns))


def append_with_defaults(
    existing: DataFrame, incoming: DataFrame, defaults: Mapping[str, object]
) -> DataFrame:
    """Append rows that may lack columns. A missing column gets its default, or null without
    one; a null that was given stays null."""
    columns: list[Column] = []
    for column in existing.schema.fields:
        if column.name in incoming.columns:
            value = F.col(column.name)
        else:
            default = defaults.get(column.name)
            value = default if isinstance(default, Column) else F.lit(default)
        columns.append(value.cast(column.dataType).alias(column.name))
    return existing.unionByName(incoming.select(*columns))


def collect_table_stats(spark: SparkSession, table: str) -> None:
    """Column statistics of a catalog table for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
