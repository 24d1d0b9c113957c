"""A quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms of three kinds: its words in lower case, the shapes of its words (runs of
letters by case, digits, and other characters as they are), and how often words and runs of three
words repeat. Terms are hashed to cells, their weights are square roots of shares, so a text of
any length is a vector of length one. The vectors of a bounded sample of labelled texts are
decomposed (a truncated singular value decomposition); the leading right vectors span the latent
space. Labelled vectors are broadcast: their number and length are fixed, whatever the corpus.

Every text is projected, its cosine with every labelled vector is taken in blocks, and the labels
of the nearest are averaged with their similarities as weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, lowest_hashes, share, store

#: Labelled texts of each label that the model is fitted on and that vote, at most.
SAMPLE_DOCS = 1500
#: Cells that words and shapes are hashed to, and steps that shares of repetition are cut into.
WORD_CELLS, SHAPE_CELLS, STEPS = 1 << 13, 1 << 11, 9
CELLS = WORD_CELLS + SHAPE_CELLS + 2 * STEPS
#: What the three kinds of terms weigh.
WORDS, SHAPES, REPEATS = 0.2, 0.5, 0.3
#: Dimensions of the latent space, and rounds that its basis is sharpened.
DIMENSIONS, ROUNDS = 48, 4
#: Labelled vectors that vote; ties with the last of them vote as well.
NEIGHBOURS = 7
#: Words that a worker remembers, and texts and cells that are worked on at a time.
MEMO, BLOCK_TEXTS, BLOCK_CELLS = 250_000, 256, 1 << 16
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """``Word's`` is ``Aa'a``, ``ABC-12`` is ``A-0``."""

    def case(run: re.Match) -> str:
        text = run[0]
        if text.isupper():
            return "A"
        return "Aa" if text[0].isupper() else "a"

    return _DIGITS.sub("0", _LETTERS.sub(case, word))


class Terms:
    """Cells and weights of texts; remembers words."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.cells: list[tuple[int, int]] = []

    def _place(self, word: str) -> int:
        found = self.places.get(word)
        if found is None:
            found = self.places[word] = len(self.places)
            bare = "".join(_LETTERS.findall(word)).lower()
            self.cells.append(
                (
                    zlib.crc32(bare.encode()) % WORD_CELLS,
                    WORD_CELLS + zlib.crc32(shape(word).encode()) % SHAPE_CELLS,
                )
            )
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a text, each once, and their weights; none for a text without a word."""
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.places) > MEMO:
            self._forget()
        known = self.places.get
        at = np.array([i if (i := known(w)) is not None else self._place(w) for w in words], np.int64)
        different, counts = np.unique(at, return_counts=True)
        pairs = np.array([self.cells[i] for i in different.tolist()], np.int64)
        cells, weights = [], []
        for column, share in ((0, WORDS), (1, SHAPES)):
            own, inverse = np.unique(pairs[:, column], return_inverse=True)
            cells.append(own)
            weights.append(np.sqrt(np.bincount(inverse, counts) * (share / n)))
        again = (at[1:] == at[:-1]).mean() if n > 1 else 0.0
        base = len(self.places)
        threes = (at[:-2] * base + at[1:-1]) * base + at[2:]
        repeated = 1 - len(np.unique(threes)) / len(threes) if n > 2 else 0.0
        first = WORD_CELLS + SHAPE_CELLS
        step = lambda x: 0 if x == 0 else 1 + min(STEPS - 2, int(x * (STEPS - 1)))
        cells.append(np.array([first + step(again), first + STEPS + step(repeated)]))
        weights.append(np.full(2, np.sqrt(REPEATS / 2)))
        return np.concatenate(cells), np.concatenate(weights)


def project(rows: list[tuple[np.ndarray, np.ndarray]], basis: np.ndarray) -> np.ndarray:
    """Rows of (cells, weights) times ``basis``, a block of cells at a time."""
    out = np.zeros((len(rows), basis.shape[1]))
    start = 0
    while start < len(rows):
        end, size = start, 0
        while end < len(rows) and (end == start or size + len(rows[end][0]) <= BLOCK_CELLS):
            size += len(rows[end][0])
            end += 1
        filled = [i for i in range(start, end) if len(rows[i][0])]
        if filled:
            cells = np.concatenate([rows[i][0] for i in filled])
            weights = np.concatenate([rows[i][1] for i in filled])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in filled[:-1])])
            out[filled] = np.add.reduceat(basis[cells] * weights[:, None], starts)
        start = end
    return out


def spread(rows: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray) -> np.ndarray:
    """The transposed rows of (cells, weights) times ``left``."""
    out = np.zeros((CELLS, left.shape[1]))
    for (cells, weights), vector in zip(rows, left):
        out[cells] += weights[:, None] * vector  # a row has each cell once
    return out


class Model(NamedTuple):
    """``basis`` spans the latent space; ``vectors`` are the labelled texts in it, of length one;
    ``votes`` are how many texts of its label each stands for; ``prior`` is the share of label 1."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 among the neighbours, by similarity; the prior where there are none."""
        out = np.full(len(rows), self.prior)
        if not len(self.vectors):
            return out
        for start in range(0, len(rows), BLOCK_TEXTS):
            near = _unit(project(rows[start : start + BLOCK_TEXTS], self.basis)) @ self.vectors.T
            near = np.round(np.maximum(near, 0.0), 9)
            last = max(0, near.shape[1] - NEIGHBOURS)
            reach = np.partition(near, last, axis=1)[:, last]
            weights = np.where(near >= reach[:, None], near, 0.0) * self.votes
            total = weights.sum(axis=1)
            found = np.flatnonzero(total > 0)
            out[start + found] = (weights @ self.labels)[found] / total[found]
        return np.clip(out, 0.0, 1.0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-12)


def latent_basis(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leading right singular vectors of the rows, by subspace iteration."""
    dimensions = min(DIMENSIONS, len(rows))
    basis = np.random.default_rng(1).standard_normal((CELLS, dimensions))
    for _ in range(ROUNDS):
        left, _ = np.linalg.qr(project(rows, basis))
        basis, _ = np.linalg.qr(spread(rows, left))
    return basis


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        found = [terms.of(t) for t in batch.column("text").to_pylist()]
        arrays = [
            pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())),
            pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("hash"), batch.column("label"), *arrays], ["hash", "label", "cells", "weights"]
        )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """Fit on at most SAMPLE_DOCS texts of label 1 and as many of label 0, those of the lowest
    hashes of the text, by ``docs`` (key, text) and ``labels`` (key, label).

    Equal texts count once, with the greater of their labels; null keys and texts and labels other
    than 0 and 1 are left out. Without labelled texts every score is 0.5. Only hashes of texts are
    shuffled, and the texts of the sample.
    """
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key"))
    known = known.agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = hashed.distinct().join(known, "key").groupBy("hash").agg(F.max("label").alias("label"))
    texts = store(texts, "vote-texts")
    number = {row["label"]: row["n"] for row in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    reach = lowest_hashes(texts, "label", SAMPLE_DOCS)
    chosen = store(texts.where(F.col("hash") <= looked_up(reach, F.col("label"))), "vote-sample")
    sample = (
        docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
        .join(chosen, "hash")
        .dropDuplicates(["hash"])
        .mapInArrow(_bags, "hash long, label int, cells array<long>, weights array<double>")
    )
    found = sorted((r["hash"], r["label"], r["cells"], r["weights"]) for r in sample.collect())
    found = [f for f in found if f[2]]
    if not found:
        return Model(np.zeros((CELLS, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.5)
    rows = [(np.array(f[2], np.int64), np.array(f[3])) for f in found]
    labels = np.array([f[1] for f in found])
    taken = {value: int((labels == value).sum()) for value in number}
    basis = latent_basis(rows)
    votes = np.array([number[value] / taken[value] for value in labels.tolist()])
    prior = number.get(1, 0) / sum(number.values())
    return Model(basis, _unit(project(rows, basis)), labels.astype(float), votes, prior)


def classify(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Replace ``text`` by the score of its quality, 0 to 1, as a double column ``out``.

    Only the text decides, and it is read whole. A text that is null or without a word has no
    vector and gets the share of label 1 among the labelled texts. Other columns and repeated
    rows stay, a column that has the name ``out`` is replaced, an empty table stays empty.
    """
    df = df.drop(out) if out != text else df
    shared = share(df.sparkSession, model, lambda model: (model, Terms()))
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = shared()
        for batch in batches:
            rows = [terms.of(t or "") for t in batch.column(text).to_pylist()]
            columns = [*(batch.column(c) for c in rest), pa.array(known.scores(rows))]
            yield pa.RecordBatch.from_arrays(columns, [*rest, out])

    fields = [f for f in df.schema if f.name != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
