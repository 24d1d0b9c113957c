"""The operational tables as a change feed leaves them: latest versions by id, and links from
parents to children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import CHANGE, OPERATIONAL
from .store import BUCKETS, RunStore, distinct, hashed


def versioned(table: str, columns: Sequence[str] | None = None) -> T.StructType:
    """Schema of a table's versions, of all its columns or of some."""
    kept = [f for f in OPERATIONAL[table].fields if columns is None or f.name in columns]
    return T.StructType([*kept, *CHANGE.fields])


def latest(rows: DataFrame, *dealt: str) -> DataFrame:
    """The latest version of each id, deletions included. A row without a version is from the
    first copy and older than any change. Columns ``dealt`` follow from the id."""
    key = [*dealt, "id"]
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(F.coalesce("change_version", F.lit(-1)).alias("_version"), *rest)
    return rows.groupBy(*key).agg(F.max(order).alias("row")).select(*key, *[F.col(f"row.{c}") for c in rest])


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not deleted, without the change columns."""
    kept = rows.filter(F.coalesce(F.col("change_kind") != "DELETE", F.lit(True)))
    return kept.drop(*CHANGE.fieldNames())


class Versions:
    """One table's latest versions, in a store by id, with all its columns or some."""

    def __init__(
        self, spark: SparkSession, path: str, table: str, buckets: int = BUCKETS, columns: Sequence[str] | None = None
    ):
        schema, bucket = versioned(table, columns), hashed("id", buckets=buckets)
        self.store = RunStore(spark, f"{path}/{table}", schema, bucket, latest, keys=["id"], dealt=buckets)

    def before(self, batch_id: int, ids: DataFrame | None = None) -> DataFrame:
        """Latest versions before a batch, all or those of some ids."""
        return self.store.read(batch_id) if ids is None else self.store.find(batch_id, ids.select("id"))


class Links:
    """Which children have named a parent, by (kind, parent). A link may be out of date: it only
    says which children to look at."""

    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("parent", T.LongType()),
            T.StructField("child", T.LongType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str, name: str = "links", buckets: int = BUCKETS):
        bucket, keys = hashed("kind", "parent", buckets=buckets), self.schema.names
        self.store = RunStore(spark, f"{path}/{name}", self.schema, bucket, distinct, keys=keys, dealt=buckets)

    def rows(self, kind: str, rows: DataFrame, parent: str, child: str = "id") -> DataFrame:
        return rows.select(
            F.lit(kind).alias("kind"), F.col(parent).cast("long").alias("parent"), F.col(child).cast("long").alias("child")
        ).dropna()

    def children(self, batch_id: int, kind: str, parents: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
        """Children (column id) of parents (first column), by links before a batch and ``fresh``."""
        keys = parents.select(F.lit(kind).alias("kind"), F.col(parents.columns[0]).alias("parent")).dropna().distinct()
        known = self.store.find(batch_id, keys)
        if fresh is not None:
            known = known.unionByName(fresh.join(keys, ["kind", "parent"], "left_semi"))
        return known.select(F.col("child").alias("id")).distinct()
