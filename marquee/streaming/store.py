"""Rows kept between micro-batches, in buckets, as few runs of Parquet files.

A batch adds one run. As soon as FAN runs have the same level they are folded into one of the
next, so a store has at most FAN - 1 runs of each level, a row is rewritten as often as there are
levels, and both grow with the logarithm of the number of batches. A run is a folder with a folder
for each bucket; a reader names the buckets it wants and touches no others.

What a store holds after a batch is written in that batch's manifest, last and in one step. The
manifest before stays, with its files, so that a batch that runs again starts where it started the
first time; what only older manifests name is deleted.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks import files

FAN = 8
BUCKETS = 64
FEW = 8


def hashed(*columns: str, buckets: int = BUCKETS) -> Column:
    """Bucket by a hash of some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("long")


class RunStore:
    """A store at ``path`` of rows of ``schema``, dealt to buckets by the column ``bucket``.

    ``fold`` joins the rows of several runs (latest versions, sums, distinct rows); folding some
    runs first and the rest later must give the same. Where the columns ``keys`` that it groups by
    are given, it takes more columns to group by, every run holds a key once, and what lies in one
    run alone is read as it is. ``dealt`` is the number of buckets then.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        bucket: Column,
        fold: Callable[[DataFrame], DataFrame],
        fan: int = FAN,
        keys: Sequence[str] = (),
        dealt: int = BUCKETS,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.bucket, self.fold, self.fan = bucket, fold, fan
        self.keys, self.dealt = keys, dealt

    # -- manifests --------------------------------------------------------------------------

    def _manifests(self) -> list[int]:
        names = files.children(self.spark, f"{self.path}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, batch_id: int) -> str:
        return f"{self.path}/manifests/{batch_id:012d}.json"

    def runs(self, before: int) -> list[dict[str, Any]]:
        """Runs (folder, level, buckets) as they are before batch ``before``."""
        earlier = [b for b in self._manifests() if b < before]
        return json.loads(files.read_text(self.spark, self._manifest(earlier[-1]))) if earlier else []

    def kept(self, before: int) -> bool:
        """Whether batches before have added anything, be it nothing."""
        return any(b < before for b in self._manifests())

    def folders(self, before: int, buckets: Iterable[int] | None = None) -> list[str]:
        """Folders that hold the given buckets, or all."""
        wanted = None if buckets is None else set(buckets)
        return [
            f"{self.path}/runs/{run['folder']}/bucket={bucket}"
            for run in self.runs(before)
            for bucket in run["buckets"]
            if wanted is None or bucket in wanted
        ]

    def buckets(self, before: int) -> list[int]:
        return sorted({b for run in self.runs(before) for b in run["buckets"]})

    # -- rows -------------------------------------------------------------------------------

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, before: int, buckets: Iterable[int] | None = None) -> DataFrame:
        """Folded rows of some buckets, or of all, as they are before a batch."""
        folders = self.folders(before, buckets)
        return self._read(folders) if self._folded(folders) else self.fold(self._read(folders))

    def alone(self, before: int, buckets: Iterable[int] | None = None) -> bool:
        """Whether buckets can be read as they lie."""
        return self._folded(self.folders(before, buckets))

    def _folded(self, folders: list[str]) -> bool:
        """Whether no key can lie in two of the folders."""
        times = Counter(folder.rsplit("/", 1)[1] for folder in folders)
        return bool(self.keys) and all(n == 1 for n in times.values())

    def find(self, before: int, keys: DataFrame, others: bool = False) -> DataFrame:
        """Folded rows whose columns agree with a row of ``keys``, and perhaps ``others``. Only the
        buckets of the keys are read; their numbers are all that comes to the driver. A store of
        FEW folders is not worth the question."""
        folders = self.folders(before)
        if len(folders) > FEW:
            wanted = [r[0] for r in keys.select(self.bucket.alias("bucket")).distinct().collect()]
            folders = self.folders(before, wanted)
        if not folders:
            return self._read(folders)
        found, folded = self._read(folders), self._folded(folders)
        if folded and others:
            return found
        found = found.join(keys.distinct(), keys.columns, "left_semi")
        return found if folded else self.fold(found)

    def put(self, rows: DataFrame, batch_id: int, folded: bool = False) -> dict[str, Any]:
        """Write the rows of a batch as a run that counts once it is added.

        Unless they are ``folded``, rows are dealt to tasks by bucket and key, once: there they are
        folded and written, and a task has few buckets.
        """
        name = f"{batch_id:012d}-0"
        if folded:
            run = self._write(rows, name, 0)
        else:
            tasks = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
            tasks = self.spark.conf.get(tasks, None) or self.spark.conf.get("spark.sql.shuffle.partitions")
            parts = math.ceil(4 * int(tasks) / self.dealt)
            part = F.pmod(F.hash(*self.keys), F.lit(parts))
            rows = rows.select(*self.schema.names, self.bucket.alias("bucket"), part.alias("_part"))
            rows = self.fold(rows.repartition("bucket", "_part"), "bucket", "_part")
            run = self._written(rows.select(*self.schema.names, "bucket"), name, 0)
        if not run["buckets"]:
            files.remove(self.spark, f"{self.path}/runs/{name}")
        return run

    def rows(self, run: dict[str, Any]) -> DataFrame:
        """The rows of a run."""
        return self._read([f"{self.path}/runs/{run['folder']}/bucket={bucket}" for bucket in run["buckets"]])

    def add(self, rows: DataFrame | dict[str, Any], batch_id: int, drop: Iterable[int] = ()) -> None:
        """Add the rows of a batch, or the run they were put in, without the buckets ``drop`` of
        earlier ones.

        Adding again under the same batch replaces what was added.
        """
        gone = set(drop)
        runs = [{**run, "buckets": [b for b in run["buckets"] if b not in gone]} for run in self.runs(batch_id)]
        runs = [run for run in runs if run["buckets"]]
        fresh = rows if isinstance(rows, dict) else self._write(rows, f"{batch_id:012d}-0", 0)
        if fresh["buckets"]:
            runs.append(fresh)
        level = 0
        while sum(run["level"] == level for run in runs) >= self.fan:
            merged = [run for run in runs if run["level"] == level]
            folders = [f"{self.path}/runs/{run['folder']}/bucket={b}" for run in merged for b in run["buckets"]]
            level += 1
            joined = self._write(self.fold(self._read(folders)), f"{batch_id:012d}-{level}", level)
            runs = [run for run in runs if run["level"] != level - 1] + [joined] * bool(joined["buckets"])
        files.replace_text(self.spark, self._manifest(batch_id), json.dumps(runs))
        self._clean(batch_id)

    def _write(self, rows: DataFrame, folder: str, level: int) -> dict[str, Any]:
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket)
        return self._written(dealt.hint("rebalance", F.col("bucket")), folder, level)

    def _written(self, dealt: DataFrame, folder: str, level: int) -> dict[str, Any]:
        path = f"{self.path}/runs/{folder}"
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        names = [n for n in files.children(self.spark, path) if n.startswith("bucket=")]
        return {"folder": folder, "level": level, "buckets": sorted(int(n.removeprefix("bucket=")) for n in names)}

    def _clean(self, batch_id: int) -> None:
        manifests = self._manifests()
        kept = [b for b in manifests if b <= batch_id][-2:]
        named = {
            run["folder"]
            for b in manifests
            if b >= kept[0]
            for run in json.loads(files.read_text(self.spark, self._manifest(b)))
        }
        for batch in manifests:
            if batch < kept[0]:
                files.remove(self.spark, self._manifest(batch))
        for folder in files.children(self.spark, f"{self.path}/runs"):
            if folder not in named and int(folder.split("-")[0]) <= batch_id:
                files.remove(self.spark, f"{self.path}/runs/{folder}")


def distinct(rows: DataFrame, *dealt: str) -> DataFrame:
    """Fold for rows that are only there or not."""
    return rows.distinct()


def summed(*keys: str) -> Callable[..., DataFrame]:
    """Fold that adds up the differences ``n`` of a key; a key without any left goes."""

    def fold(rows: DataFrame, *dealt: str) -> DataFrame:
        return rows.groupBy(*dealt, *keys).agg(F.sum("n").alias("n")).filter("n <> 0")

    return fold
