"""Centroid clustering whose assignment is the threshold algorithm over sorted centroid lists.

Each dimension keeps the centroids sorted by their component. From a vector's own component the
list is walked outward, nearer side first, one step in every dimension per round. A centroid that
is met for the first time gets its exact distance. A centroid not met yet is at least as far in
each dimension as the place the walk has reached there, so once the sum of the squared reaches
strictly exceeds the best exact distance, no unseen centroid can win or tie, and the walk ends.

Vectors are quantised to integers, so every distance and every mean is exact, and the result does
not depend on the order of rows or on how they are dealt to tasks. A task holds one Arrow batch,
the centroids and one sum for each of them; only the added sums of the centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Integers that a unit of a component is divided into.
SCALE = 256
#: Quantised components are smaller than this in size, so that squared distances of a thousand
#: dimensions fit into 64 bits.
LARGEST = 1 << 25
#: Vectors walked at a time.
WALK_ROWS = 512


def quantised(vector: Column, dim: int) -> Column:
    """floor(SCALE * x) of each component as array<int>; null for vectors that take no part.

    Those are vectors that are null or of another length than ``dim``, and those that hold a null
    or non-finite component or one of a size of LARGEST / SCALE or more.
    """
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    return F.when((F.size(x) == dim) & fits, F.transform(x, lambda c: F.floor(c * SCALE).cast("int")))


class SortedLists:
    """The centroids of a round, sorted by component once for each dimension."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        count, dim = self.centroids.shape
        self.lanes = np.arange(dim)
        order = np.argsort(self.centroids, axis=0, kind="stable")
        # A place beyond each end, farther than any component is; it stands for no centroid.
        end = np.full((1, dim), 4 * LARGEST)
        self.values = np.concatenate([-end, np.take_along_axis(self.centroids, order, 0), end])
        self.ids = np.concatenate([np.full((1, dim), count), order, np.full((1, dim), count)])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each vector the nearest centroid (on a tie the smaller number) and its squared
        distance; and the number of exact distances taken."""
        count, far = len(self.centroids), np.iinfo(np.int64).max
        places = [np.searchsorted(self.values[1:-1, d], vectors[:, d]) for d in self.lanes]
        high = np.stack(places, axis=1) + 1
        low = high - 1
        exact = np.full((len(vectors), count + 1), far)
        active, taken = np.arange(len(vectors)), 0
        while len(active):
            at = vectors[active]
            below = at - self.values[low, self.lanes]
            above = self.values[high, self.lanes] - at
            down = below <= above
            met = np.zeros((len(active), count + 1), bool)
            np.put_along_axis(met, self.ids[np.where(down, low, high), self.lanes], True, axis=1)
            met &= exact[active] == far
            row, centroid = np.nonzero(met[:, :count])
            exact[active[row], centroid] = ((at[row] - self.centroids[centroid]) ** 2).sum(axis=1)
            taken += len(row)
            reach = np.minimum(np.where(down, below, above), 2 * LARGEST)
            known = exact[active, :count]
            going = ((reach**2).sum(axis=1) <= known.min(axis=1)) & (known == far).any(axis=1)
            low, high = (low - down)[going], (high + ~down)[going]
            active = active[going]
        who = exact[:, :count].argmin(axis=1)
        return who, exact[np.arange(len(vectors)), who], taken


def _walks(column: pa.Array, lists: SortedLists) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors of a batch in parts, each with the nearest centroids and the distances."""
    vectors = column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)
    for start in range(0, len(vectors), WALK_ROWS):
        part = vectors[start : start + WALK_ROWS]
        who, distance, _ = lists.nearest(part)
        yield part, who, distance


def _assigner(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            if batch.num_rows:
                found = list(_walks(batch.column("vector"), lists))
                who = np.concatenate([f[1] for f in found]).astype(np.int32)
                distance = np.concatenate([f[2] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(who), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return run


def _adder(centroids: list[list[int]]) -> Callable:
    """Sums and counts of each centroid's vectors, one row per centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        sums, counts = np.zeros_like(lists.centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                for part, who, _ in _walks(batch.column("vector"), lists):
                    np.add.at(sums, who, part)
                    counts += np.bincount(who, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    return run


def _means(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; one without vectors stays."""
    parts = vectors.select("vector").mapInArrow(_adder(centroids), "cluster int, n long, sums array<long>")
    total = (
        parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    )
    moved = [list(c) for c in centroids]
    for row in total.collect():  # as many rows as the centroids have components
        moved[row.cluster][row.place] = row.total // row.n
    return moved


def cluster(vectors: DataFrame, k: int, rounds: int, dim: int, seed: int) -> DataFrame:
    """Cluster ``vectors`` (vec_id, embedding) around ``k`` centroids.

    The first centroids are the k vectors with the least sha256 of ``seed:vec_id``, in that
    order (fewer if there are fewer vectors). Each round moves every centroid that has vectors
    to the floor of their mean. Returns vec_id, cluster, distance (squared), cluster_inertia and
    inertia (distances summed over the cluster and over all) and centroid_sha256 (of the
    centroid's components, joined by commas), one row for each vector that takes part.

    Vectors for which ``quantised`` gives null are left out. Every row counts as a vector, so
    repeated rows weigh as often as they come; of equal ids the lesser vector is first. Rows
    without an id are clustered, but are centroids only after all others. Other columns do not
    matter, and an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), dim).alias("vector"))
    rows = store(rows.where(F.col("vector").isNotNull()), "centroid-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        found = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        centroids = []
    else:
        centroids = [list(row.vector) for row in first]
        for _ in range(rounds):
            centroids = _means(rows, centroids)
        found = store(rows.mapInArrow(_assigner(centroids), "vec_id long, cluster int, distance long"), "centroid-clusters")
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([sums.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of_cluster(prints, "string").alias("centroid_sha256"),
    )
