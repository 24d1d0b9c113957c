"""Near-duplicate classes against all pairs, and signatures against exact similarity."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import bagminhash as bag
from marquee.llm import near_dup
from marquee.llm.common import prepare
from marquee.llm.components import components
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def multiset(text):
    words = (text or "").encode().split()
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else Counter()


def exact(a, b):
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def plain_classes(rows):
    """Least id of each row's class, by comparing all pairs."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_row = rows[i] == rows[j]
            if same_row or (sets[i] and sets[j] and exact(sets[i], sets[j]) >= 0.8):
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return [(key, least[root(i)], len(groups[root(i)])) for i, (key, _) in enumerate(rows)]


def test_overlap_is_exact():
    draw = random.Random(1)
    for _ in range(200):
        a = [draw.choice("abcdefg") for _ in range(draw.randrange(40))]
        b = [draw.choice("zz") if draw.random() < 0.05 else x for x in a] + ["q"] * draw.randrange(4)
        a, b = " ".join(a), " ".join(b)
        found = bag.similarity(bag.shingles(bag.normal(a)), bag.shingles(bag.normal(b)))
        assert found == pytest.approx(exact(multiset(a), multiset(b)))


def test_hashing_in_chunks_changes_nothing(monkeypatch):
    text = bag.normal("some words that are cut into chunks of a few bytes each time " * 9)
    whole = bag.word_hashes(text)
    monkeypatch.setattr(bag, "CHUNK", 10)
    assert (bag.word_hashes(text) == whole).all()


def test_signatures_are_unbiased():
    draw = np.random.default_rng(0)
    errors, spread = [], []
    for _ in range(150):
        elements = np.unique(draw.integers(0, 1 << 62, draw.integers(3, 150)).astype(np.uint64))
        a = draw.integers(1, draw.choice([2, 4, 60]), len(elements))
        b = np.maximum(1, a + draw.integers(-3, 4, len(elements)) * (draw.random(len(elements)) < 0.3))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        match = (bag.signature(elements, a) == bag.signature(elements, b)).mean()
        errors.append(match - true)
        spread.append(true * (1 - true) / bag.REGISTERS)
    assert abs(np.mean(errors)) < 4 * np.sqrt(np.mean(spread) / len(errors))
    assert np.mean(np.square(errors)) < 1.6 * np.mean(spread)


def test_components(spark):
    prepare(spark)
    draw = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    loose = [(draw.randrange(1000, 1060), draw.randrange(1000, 1060)) for _ in range(45)]
    links = chain + star + loose + [(7, 7), (None, 3)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {x: root(x) for x in parent}


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = QUERIES["op7_near_dup"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in found) == sorted(plain_classes(rows))
    assert sorted(r.doc_id for r in found if r.kept) == sorted({r.class_id for r in found})


def test_links_that_no_pivot_shows(spark):
    """Copies edited step by step: each is like the one before, few are like the first."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = draw.randrange(280)
        words[at : at + 3] = [f"n{i}x{k}" for k in range(3)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    found = near_dup.classes(df).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in found) == sorted(plain_classes(rows))


def test_odd_rows(odd_documents, no_documents):
    clashing = odd_documents.withColumn("node", F.lit(1)).withColumn("class_id", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    found = near_dup.classes(clashing).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in found), key=repr) == sorted(plain_classes(rows), key=repr)
    assert near_dup.classes(no_documents).collect() == []


def test_a_cell_connects_all_that_is_near():
    """Links of a cell, with the components it was given, are the components by all pairs."""
    draw = random.Random(12)
    for _ in range(40):
        base = [f"w{i % 23}" for i in range(draw.randrange(20, 80))]
        texts = []
        for _ in range(14):
            words = list(base)
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = f"n{draw.randrange(50)}"
            texts.append(" ".join(words))
        given = [draw.randrange(10) for _ in texts]
        sets = [multiset(t) for t in texts]
        near = [(i, j) for i in range(14) for j in range(i) if exact(sets[i], sets[j]) >= 0.8]

        def classes(links):
            label = list(given)
            for _ in range(14):
                for i, j in links:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
            return label

        links = near_dup.settle_cell(texts, given)
        assert len(links) < len(set(given))
        assert classes(links) == classes(near)
