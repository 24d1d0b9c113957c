"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Equal word sequences are one node from the start. The bands of a node's signature put it into
buckets, and buckets with the same members count once. All members of a bucket are first held
against one of them, its pivot, by the exact overlap of their multisets: a pair of similarity
0.8 or more is a link, and components of links are the classes. A bucket is settled when its
members are in one class, as for groups of copies, however large. Where they are not, members of
different classes are held against each other, in cells of bounded size, so that no link is lost
to a pivot that is not like both of its ends; a cell counts common shingles by an index of its
shingles and returns no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bagminhash as bag
from .common import Memo, store
from .components import components

THRESHOLD = 0.8
#: Shingles of the members on one side of a cell.
CELL_SHINGLES = 1_000_000


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, bands = [], [], []
        for text in batch.column("text").to_pylist():
            normal = bag.normal(text or "")
            elements, counts = bag.shingles(normal)
            nodes.append(bag.fingerprint(normal) if len(counts) else None)
            sizes.append(int(counts.sum()))
            bands.append(bag.band_hashes(bag.signature(elements, counts)) if len(counts) else [])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("print"),
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["key", "print", "node", "size", "bands"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs of texts that are near; neighbouring rows often share a pivot."""
    pivots = Memo(lambda text: bag.shingles(bag.normal(text)), 16)
    for batch in batches:
        pairs = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
        near = [
            bag.similarity(bag.shingles(bag.normal(a)), pivots[b]) >= THRESHOLD for a, b in pairs
        ]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts are near."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_verify, "a binary, b binary")
    )


def _alike_in_size() -> Column:
    """No pair can be near if one has fewer than THRESHOLD of the other's shingles."""
    return F.least("size_a", "size_b") >= THRESHOLD * F.greatest("size_a", "size_b")


def settle_cell(texts: list[str], components: list) -> list[tuple[int, int]]:
    """Links between members of different components: as many as connect what is near.

    One index holds all shingle occurrences of the cell (the k-th copy of a shingle is an element
    of its own, so that common elements are the overlap of multisets). The members of all but
    the largest component look theirs up and count what they have in common with each other one.
    """
    members = [_occurrences(t) for t in texts]
    sizes = np.array([len(m) for m in members])
    place = {c: i for i, c in enumerate(dict.fromkeys(components))}
    own = np.array([place[c] for c in components])
    parent = list(range(len(place)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    elements = np.concatenate(members)
    owners = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owners = elements[order], owners[order]
    largest = np.bincount(own).argmax()
    links = []
    for i in np.flatnonzero(own != largest).tolist():
        low = np.searchsorted(elements, members[i], "left")
        count = np.searchsorted(elements, members[i], "right") - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(owners[at], minlength=len(members))
        near = (common >= THRESHOLD * (sizes + sizes[i] - common)) & (own != own[i])
        for j in np.flatnonzero(near).tolist():
            x, y = root(int(own[i])), root(int(own[j]))
            if x != y:
                parent[y] = x
                links.append((i, j))
    return links


def _occurrences(text: str) -> np.ndarray:
    """The multiset of a text as a set: one element for each occurrence of each shingle."""
    elements, counts = bag.shingles(bag.normal(text))
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bag.mix(np.repeat(elements, counts) + number.astype(np.uint64))


def _settle(cell: pd.DataFrame) -> pd.DataFrame:
    links = settle_cell(cell["text"].tolist(), cell["component"].tolist())
    nodes = cell["node"].tolist()
    return pd.DataFrame([(nodes[i], nodes[j]) for i, j in links], columns=["a", "b"])


def _cells(labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of different components of the buckets of ``labelled``.

    The members of a bucket are dealt to parts of some CELL_SHINGLES shingles. Each two parts,
    and each part with itself, are a cell: a part goes to as many cells as there are parts.
    """
    parts = labelled.groupBy("bucket").agg(
        F.ceil(F.sum("size") / CELL_SHINGLES).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = (
        labelled.join(parts, "bucket")
        .select("bucket", "node", "component", part.alias("part"), F.explode(others).alias("other"))
        .withColumn("one", F.least("part", "other"))
        .withColumn("two", F.greatest("part", "other"))
    )
    return (
        dealt.join(texts, "node")
        .select("bucket", "one", "two", "node", "component", "text")
        .groupBy("bucket", "one", "two")
        .applyInPandas(_settle, "a binary, b binary")
    )


def classes(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: key, print, class, class_id, class_size, kept.

    ``print`` is a hash of the text and ``class`` a name of the class. ``class_id`` is the least key of the class, ``class_size`` its number of rows. ``kept`` is
    true for the rows of that key in the class, so that one document of each class stays. A text
    that is null or has no word is like no other: its row is a class of its own, with its own key
    as class_id. One to four words count as one shingle. Null keys are never the least, unless a
    class has no other; rows with equal key and text are the same document. An empty table gives
    an empty result.
    """
    docs = df.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text")
    )
    signed_schema = T.StructType(
        [
            *docs.drop("text").schema,
            T.StructField("node", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    signed = store(docs.mapInArrow(_sign, signed_schema), "near-dup-signatures")
    nodes = (
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("key").isNull(), "key", "print", "size", "bands")).alias("one"),
        )
        .select("node", "one.key", "one.print", "one.size", "one.bands")
    )
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = (
        members.groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
        )
        .where("n > 1")
        .groupBy("n", "x", "y")  # buckets with the same members are one
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    members = store(members.join(shared, "bucket"), "near-dup-members")

    wanted = nodes.select("node", "key", "print").join(members.select("node").distinct(), "node")
    same = docs["key"].eqNullSafe(wanted["key"]) & (docs["print"] == wanted["print"])
    texts = docs.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    texts = store(texts, "near-dup-texts")

    # One order of all nodes: the same few of them are pivots in all their buckets.
    first = F.min(F.struct(F.xxhash64("node"), "node", "size")).alias("pivot")
    pivots = members.groupBy("bucket").agg(first)
    pairs = (
        members.join(pivots, "bucket")
        .select(
            F.col("node").alias("a"),
            F.col("size").alias("size_a"),
            F.col("pivot.node").alias("b"),
            F.col("pivot.size").alias("size_b"),
        )
        .where(F.col("a") != F.col("b"))
        .where(_alike_in_size())
        .select("a", "b")
        .distinct()
    )
    links = store(_links(pairs, texts), "near-dup-links")
    found = components(links)

    component = F.coalesce("component", "node")
    labelled = members.join(found, "node", "left").withColumn("component", component)
    open_ones = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
        .where("least != most and n > 2")  # two members have met as member and pivot
        .select("bucket")
    )
    labelled = store(labelled.join(open_ones, "bucket"), "near-dup-open")
    more = store(_cells(labelled, texts), "near-dup-links")
    found = components(found.toDF("a", "b").union(more))

    # A text without words is a class of its own, told by its key and print.
    alone = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("print"))
    rows = signed.join(found, "node", "left").select(
        "key",
        "print",
        F.coalesce("component", "node", F.encode(alone, "UTF-8")).alias("class"),
    )
    named = rows.groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, "class").select(
        F.col("key").alias(key),
        "print",
        "class",
        "class_id",
        "class_size",
        F.col("key").eqNullSafe(F.col("class_id")).alias("kept"),
    )
