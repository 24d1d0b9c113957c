"""Line dedup against a plain pass over sorted documents."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from marquee.llm import line_dedup
from marquee.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """{(doc_id, text): (text, lines, removed)}; unlike the operator, it needs no hashes."""
    documents = {(k, t) for k, t in rows}
    split = {}
    for key, text in documents:
        lines = (text or "").split("\n")
        split[key, text] = lines, [i for i, x in enumerate(lines) if WORD.search(x)]
    first = {}
    order = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0))
    windows = {}
    for document in order:
        lines, at = split[document]
        strip = [lines[i].strip(" \t\v\f\r") for i in at]
        windows[document] = [tuple(strip[i : i + 3]) for i in range(len(at) - 2)]
        for i, window in enumerate(windows[document]):
            first.setdefault(window, (document, i))
    out = {}
    for document in order:
        lines, at = split[document]
        later = [i for i, w in enumerate(windows[document]) if first[w] != (document, i)]
        covered = {at[i + k] for i in later for k in range(3)}
        text = "\n".join(x for i, x in enumerate(lines) if i not in covered)
        out[document] = (text if covered else document[1], len(at), len(covered))
    return out


def test_random_texts(spark):
    prepare(spark)
    draw = random.Random(6)
    rows = []
    for i in range(150):
        lines = [draw.choice("abcde") * draw.randrange(3) + draw.choice(["", " ", "\r"]) for _ in range(draw.randrange(14))]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(rows)
    for row, (key, text) in zip(line_dedup.dedup_lines(df).orderBy("doc_id").collect(), rows):
        assert (row.text, row.n_lines, row.n_removed) == expected[key, text]


def test_odd_rows(odd_documents, no_documents):
    clashing = odd_documents.withColumn("n_lines", F.lit("x")).withColumn("key", F.lit(1)).withColumn("place", F.lit(1))
    source = [(r.doc_id, r.text) for r in odd_documents.collect()]
    expected = plain(source)
    out = line_dedup.dedup_lines(clashing)
    assert set(out.columns) == {*clashing.columns, "n_removed"}
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
    assert found == sorted(((k, *expected[k, t]) for k, t in source), key=repr)
    assert [r[3] for r in found if r[0] == 9] == [5] and [r[3] for r in found if r[0] == 7] == [0]
    assert line_dedup.dedup_lines(no_documents).collect() == []
