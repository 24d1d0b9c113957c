"""Published tables: every version in a folder of its own, and a pointer to the current one.

A reader resolves the pointer once and stays with that version; a writer replaces the pointer last
and in one step. So there is a table at any time, and a failed run changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

POINTER = "_current"
#: Versions that stay, the current one included: readers of the one before may still be at work.
KEPT = 2


def resolve(spark: SparkSession, path: str) -> str:
    """Folder of the current version; ``path`` itself for a plain folder of files."""
    root = path.rstrip("/")
    pointer = f"{root}/{POINTER}"
    return f"{root}/{files.read_text(spark, pointer)}" if files.exists(spark, pointer) else root


def publish(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("year", "month_num"),
    sort_by: Sequence[str] = ("booking_date", "movie_id"),
    lookup_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> str:
    """Write ``df`` as the next version of the table at ``path`` and return its folder.

    Rows are spread by partition, so that one is a few well-sized files, and sorted, so that
    footers let scans skip row groups. Columns of ``lookup_by`` get Bloom filters: a scan for one
    of their values skips the row groups that do not hold it. One writer at a time.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    numbers = [int(n.removeprefix("version-")) for n in files.children(spark, root) if n.startswith("version-")]
    name = f"version-{max(numbers, default=0) + 1:09d}"
    out = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    out = out.sortWithinPartitions(*partition_by, *sort_by) if sort_by else out
    writer = out.write.options(**(options or {}))
    if lookup_by:  # filters as large as the values of a row group ask for, not the most allowed
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in lookup_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(*partition_by).parquet(f"{root}/{name}")
    files.replace_text(spark, f"{root}/{POINTER}", name)
    for number in sorted(numbers)[: -(KEPT - 1)]:
        files.remove(spark, f"{root}/version-{number:09d}")
    return f"{root}/{name}"
