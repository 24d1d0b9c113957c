"""Mixing: targets by plain resharing, the order and the schedule by their laws."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import mixing
from marquee.llm.common import prepare
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share, cap at three times the size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **{s: level * weight[s] for s in free}}
        capped.update({s: 3.0 * sizes[s] for s in above})


def check(rows, texts):
    sizes, taken, target, copies = defaultdict(int), defaultdict(int), {}, defaultdict(list)
    for row in rows:
        assert row.size == len(SIZE.findall(row.text or ""))
        assert 0 <= row.taken <= 3 * row.size
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        target[row.source] = row.target
        assert len(row.positions) == (-(-row.taken // row.size) if row.taken else 0)
        assert all(0 <= p <= 1 for p in row.positions) and row.positions == sorted(row.positions)
        for i, p in enumerate(row.positions):
            copies[row.source].append((p, min(row.size, row.taken - i * row.size)))
    expected = plain_targets(sizes)
    for source, size in sizes.items():
        assert target[source] == pytest.approx(expected[source])
        assert taken[source] == round(expected[source])
        assert {r.source_size for r in rows if r.source == source} == {size}
    return copies, target


def test_documents(spark):
    docs = prepare(spark).read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs, 7).collect()
    copies, target = check(rows, docs)
    plan = mixing.plan(spark.createDataFrame(
        [(r.source, r.source_size) for r in {r.source: r for r in rows}.values()], "source string, source_size long"
    )).collect()
    tilt = {r.source: r.tilt for r in plan}
    assert sum(tilt[s] * target[s] for s in tilt) == pytest.approx(0, abs=1e-3 * sum(target.values()))
    for source, parts in copies.items():
        before = 0
        for position, words in sorted(parts):
            # words given until t are the integral of the rate, at the start of every copy
            given = target[source] * (position + tilt[source] * (position**2 - position))
            assert given == pytest.approx(before, abs=1e-6 * max(1, target[source]) + 1e-3)
            before += words


def test_reruns_agree_whatever_the_partitions(spark):
    docs = prepare(spark).read.parquet(f"{SMALL}/documents.parquet")
    key = lambda r: (r.doc_id, r.taken, r.positions)
    again = sorted(map(key, mixing.mix(docs.repartition(7), 7).collect()))
    assert again == sorted(map(key, mixing.mix(docs, 7).collect()))


def test_training_order(spark):
    docs = prepare(spark).read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, 7)
    ordered = mixing.training_order(mixed, ["doc_id"]).collect()
    positions = [r.position for r in ordered]
    assert positions == sorted(positions)
    whole = sum(r.size * int(r.taken / r.size + 0.5) for r in mixed.collect() if r.size)
    size = {r.doc_id: r.size for r in mixed.collect()}
    assert sum(size[r.doc_id] for r in ordered) == whole


def test_registered_query(spark):
    rows = QUERIES["op8_mixing"](spark, SMALL).collect()
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), abs=20)


def test_odd_rows(odd_documents, no_documents):
    clashing = odd_documents.withColumn("target", F.lit("x")).withColumn("draw", F.lit(1)).withColumn("weight", F.lit(2))
    out = mixing.mix(clashing, 7)
    assert set(clashing.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    check(rows, odd_documents)
    assert mixing.mix(no_documents, 7).collect() == []


def test_query_sorts_by_time(spark, tmp_path):
    """Rows come as training first meets them, documents that are not taken last."""
    docs = [(i, "word " * (i % 7) + "end", "abc"[i % 3], None) for i in range(60)] + [(99, None, "a", None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    found = [r.first_position for r in QUERIES["op8_mixing"](spark, str(tmp_path)).collect()]
    taken = [p for p in found if p is not None]
    assert len(found) == 61 and taken == sorted(taken) and found[: len(taken)] == taken
    assert len(set(taken)) > 30 and found[-1] is None
