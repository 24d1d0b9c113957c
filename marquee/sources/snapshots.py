"""Batch reads of the eight operational tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.publish import resolve
from .schemas import CHANGE, FACT_BOOKINGS, OPERATIONAL

Model = dict[str, DataFrame]


def split_predicates(points: Sequence[int], column: str = "id") -> list[str]:
    """Conditions that deal rows to ranges between ``points``: each row, also one without a value,
    meets exactly one of them."""
    cuts = sorted(set(points))
    if not cuts:
        return ["1 = 1"]
    lowest = [f"{column} < {cuts[0]} OR {column} IS NULL"]
    between = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(cuts, cuts[1:])]
    return [*lowest, *between, f"{column} >= {cuts[-1]}"]


def split_query(table: str, parts: int, column: str = "id") -> str:
    """SQL for the least value of each of ``parts`` equally large parts of a table but the first.

    Equal depth, not equal width: ids that were never used or are long gone make no part small.
    """
    return (
        f"SELECT MIN({column}) AS point FROM (SELECT {column}, NTILE({parts}) OVER (ORDER BY {column}) AS part "
        f"FROM {table} WHERE {column} IS NOT NULL) parts WHERE part > 1 GROUP BY part"
    )


@dataclass(frozen=True)
class JdbcSource:
    """Operational database. Each table is read in ``partitions`` parallel ranges of its id.

    The ranges hold equally many rows; the database finds their bounds in its index of the ids.
    ``by_width`` makes them equally wide instead, for databases without window functions.
    """

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)
    partitions: int = 64
    fetch_size: int = 10_000
    by_width: bool = False

    def settings(self) -> dict[str, str]:
        return {"fetchsize": str(self.fetch_size), "preferTimestampNTZ": "true", **self.properties}

    def options(self, table: str, low: int, high: int) -> dict[str, str]:
        return {
            "url": self.url,
            "dbtable": table,
            "partitionColumn": "id",
            "lowerBound": str(low),
            "upperBound": str(high + 1),
            "numPartitions": str(self.partitions),
            **self.settings(),
        }

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        rows = self._by_width(spark, table) if self.by_width else self._by_depth(spark, table)
        return rows.select(
            *[rows[f.name].cast(f.dataType).alias(f.name) for f in OPERATIONAL[table].fields]
        )

    def _ask(self, spark: SparkSession, query: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=self.url, query=query, **self.properties).load()

    def _by_depth(self, spark: SparkSession, table: str) -> DataFrame:
        points = self._ask(spark, split_query(table, self.partitions)).collect()  # as many as partitions
        predicates = split_predicates([row[0] for row in points])
        return spark.read.jdbc(self.url, table, predicates=predicates, properties=self.settings())

    def _by_width(self, spark: SparkSession, table: str) -> DataFrame:
        bounds = self._ask(spark, f"SELECT MIN(id) AS lo, MAX(id) AS hi FROM {table}").first()
        options = self.options(table, bounds["lo"] or 0, bounds["hi"] or 0)
        return spark.read.format("jdbc").options(**options).load()


def read_changes(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All versions of the rows of one landing table, with CHANGE columns (null in a first copy)."""
    schema = T.StructType([*OPERATIONAL[table].fields, *CHANGE.fields])
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{table}")


def current_rows(changes: DataFrame) -> DataFrame:
    """The latest version of every row, without those whose latest version is a deletion.

    A row without a version is from the first copy and older than any change. ``max`` of a struct
    combines before the shuffle, so a row with very many versions is one per task by then.
    """
    columns = [c for c in changes.columns if c not in CHANGE.fieldNames()]
    version = F.struct(
        F.coalesce("change_version", F.lit(-1)).alias("version"), "change_kind", *columns
    )
    latest = changes.groupBy("id").agg(F.max(version).alias("row"))
    kept = latest.filter(F.coalesce(F.col("row.change_kind") != "DELETE", F.lit(True)))
    return kept.select(*[F.col(f"row.{c}").alias(c) for c in columns])


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One operational table of a folder. It may hold changes of rows, as a change feed lands them;
    the latest version counts. A plain copy has no change columns, and nothing to fold."""
    path = f"{root.rstrip('/')}/{name}"
    if "change_version" in spark.read.option("mergeSchema", True).parquet(path).columns:
        return current_rows(read_changes(spark, root, name))
    return spark.read.schema(OPERATIONAL[name]).parquet(path)


def load_booking_model(spark: SparkSession, source: str | JdbcSource) -> Model:
    """Read the operational tables from a folder of Parquet tables or a database."""
    if isinstance(source, JdbcSource):
        return {name: source.read(spark, name) for name in OPERATIONAL}
    return {name: load_table(spark, source, name) for name in OPERATIONAL}


def read_fact(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """Published fact, optionally only the months from ``since`` on.

    The month filter prunes whole partitions; the day filter of a report then only has to skip
    row groups inside them. The version that is current now is the one that is read.
    """
    fact = spark.read.schema(FACT_BOOKINGS).parquet(resolve(spark, path))
    if since is None:
        return fact
    year, month = F.col("year"), F.col("month_num")
    return fact.filter((year > since.year) | ((year == since.year) & (month >= since.month)))
