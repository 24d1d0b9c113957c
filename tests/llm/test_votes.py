"""Quality votes against dense cosines and held-out labels."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import votes
from marquee.llm.common import lowest_hashes, prepare
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def dense(text):
    """The term vector of a text, cell by cell."""
    out, words = np.zeros(votes.CELLS), text.split()
    counts = {}
    for word in words:
        bare = "".join(c for c in word if c.isalpha()).lower()
        for key in (
            zlib.crc32(bare.encode()) % votes.WORD_CELLS,
            votes.WORD_CELLS + zlib.crc32(votes.shape(word).encode()) % votes.SHAPE_CELLS,
        ):
            counts[key] = counts.get(key, 0) + 1
    for key, n in counts.items():
        share = votes.WORDS if key < votes.WORD_CELLS else votes.SHAPES
        out[key] = (share * n / len(words)) ** 0.5
    if words:
        again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
        threes = list(zip(words, words[1:], words[2:]))
        repeated = 1 - len(set(threes)) / len(threes) if threes else 0
        for i, x in enumerate((again, repeated)):
            place = 0 if x == 0 else 1 + min(votes.STEPS - 2, int(x * (votes.STEPS - 1)))
            out[votes.WORD_CELLS + votes.SHAPE_CELLS + i * votes.STEPS + place] = (votes.REPEATS / 2) ** 0.5
    return out


def some_texts(n=120):
    draw = random.Random(2)
    out = []
    for i in range(n):
        words = [draw.choice(["a", "Bc", "DEF", "x###", "ü9", "don't", "end."]) + str(draw.randrange(9)) for _ in range(draw.randrange(1, 40))]
        out.append(" ".join(words * draw.choice([1, 1, 3])))
    return out


def test_scores_are_votes_of_the_nearest():
    texts = some_texts()
    terms = votes.Terms()
    rows = [terms.of(t) for t in texts]
    vectors = np.array([dense(t) for t in texts])
    for (cells, weights), vector in zip(rows, vectors):
        bag = np.zeros(votes.CELLS)
        bag[cells] = weights
        assert np.allclose(bag, vector) and np.isclose((vector**2).sum(), 1)
    basis = votes.latent_basis(rows[:80])
    labels = np.array([float("###" in t) for t in texts[:80]])
    weights = 1.0 + labels
    known = vectors[:80] @ basis
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    model = votes.Model(basis, known, labels, weights, 0.5)
    for vector, score in zip(vectors, model.scores(rows)):
        own = vector @ basis
        near = np.round(np.maximum(known @ own / np.linalg.norm(own), 0), 9)
        reach = sorted(near)[-votes.NEIGHBOURS]
        voting = near >= reach
        total = (near * weights)[voting].sum()
        assert np.isclose(score, (near * weights * labels)[voting].sum() / total, atol=1e-6)


def test_basis_spans_the_leading_singular_vectors(monkeypatch):
    monkeypatch.setattr(votes, "DIMENSIONS", 3)
    monkeypatch.setattr(votes, "ROUNDS", 60)
    texts = some_texts(60)
    matrix = np.array([dense(t) for t in texts])
    terms = votes.Terms()
    basis = votes.latent_basis([terms.of(t) for t in texts])
    exact = np.linalg.svd(matrix, full_matrices=False)[2][:3].T
    assert np.linalg.norm(basis @ basis.T @ exact - exact) < 1e-3


def test_held_out_labels(spark):
    found = QUERIES["op11_quality_votes"](spark, SMALL)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum((s >= 0.5) == bool(q) for s, q in held) >= 0.97 * len(held)
    pairs = [(a, b) for a, x in held for b, y in held if x > y]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) >= 0.98 * len(pairs)


def test_odd_rows(spark, odd_documents, no_documents):
    marks = [(i, int(i < 6)) for i in range(12)] + [(8, 0), (None, 1), (77, 1), (9, None), (10, 5)]
    labels = spark.createDataFrame(marks, "doc_id long, label int").withColumn("hash", F.lit("x"))
    model = votes.fit(odd_documents.withColumn("hash", F.lit("x")), labels)
    named = odd_documents.withColumn("score", F.lit("x")).withColumn("label", F.lit(1)).withColumn("hash", F.lit(2))
    found = votes.classify(named, model).collect()
    assert len(found) == odd_documents.count()
    assert all(0 <= r.score <= 1 and r.label == 1 and r.hash == 2 for r in found)
    assert {r.score for r in found if r.doc_id in (2, 3, 4)} == {model.prior}
    assert len({r.score for r in found if r.doc_id == 8}) == 1
    assert votes.classify(no_documents, model).collect() == []
    none = votes.fit(no_documents, labels)
    assert {r.score for r in votes.classify(odd_documents, none).collect()} == {0.5}


def test_one_label_only(spark, odd_documents):
    labels = odd_documents.select("doc_id", F.lit(0).alias("label"))
    assert {r.score for r in votes.classify(odd_documents, votes.fit(odd_documents, labels)).collect()} == {0.0}


def test_lowest_hashes(spark):
    draw = random.Random(4)
    rows = [(draw.choice("aaabc"), draw.randrange(-(2**63), 2**63)) for _ in range(3000)]
    rows += [("b", h) for g, h in rows if g == "b"] + [("d", -1), ("d", -1), (None, 4)]
    rows += [("e", (7 << 30) + i) for i in range(500)]  # all alike in their leading bits
    df = prepare(spark).createDataFrame(rows, "kind string, hash long")
    for n in (1, 40, 499):
        expected = {g: sorted({h for k, h in rows if k == g})[:n][-1] for g in "abcde"}
        assert lowest_hashes(df, "kind", n) == expected
    assert lowest_hashes(df.where("false"), "kind", 3) == {}
