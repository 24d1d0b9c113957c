"""Quality rules against a plain reading of the texts and exact binomial sums."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marquee.llm import quality
from marquee.llm.common import prepare
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    word = WORD.findall(text or "")
    windows = [tuple(word[i : i + 3]) for i in range(len(word) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    signs = sum(c in "#*$%&|<>" for c in text or "")
    return len(word), sum(map(len, word)), signs, len(lines) - len(set(lines)), len(covered)


def found(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_base_counts(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op2_quality"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n, *_, repeated = counts(texts[row.doc_id])
        assert found(row) == counts(texts[row.doc_id])
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (row.base_failed and row.kept)


def test_repeats_that_touch_and_overlap(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(60))) for _ in range(200)]
    texts += ["a b c a b c", "a b c x a b c", "a a a a", "a a a", "a b", "x\ny\nx\n\n \n", " ", "#|x<>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in quality.base_counts(df).collect():
        assert found(row) == counts(row.text), row.text


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 400), (0, 1000), (7, 1000), (12, 1000), (40, 5000), (600, 60_000), (2, 20)]
    df = spark.createDataFrame(cases, "k long, n long")
    risk = 0.0125
    for row in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), risk).alias("p")).collect():
        exact = sum(
            math.exp(
                math.lgamma(row.n + 1) - math.lgamma(i + 1) - math.lgamma(row.n - i + 1)
                + i * math.log(risk) + (row.n - i) * math.log1p(-risk)
            )
            for i in range(row.k + 1)
        )
        if row.k >= row.n * risk:
            assert row.p == 1.0 and exact > 0.4
        else:
            assert math.isclose(row.p, exact, rel_tol=1e-8)


def labelled_texts(n):
    draw = random.Random(4)
    clean = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(80))
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        text = clean().replace(" ", "*** ") if junk else clean()
        rows.append((i, text, "en" if i % 3 else "fr"))
        labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_certified_cutoffs_catch_junk_and_keep_the_rest(spark):
    prepare(spark)
    rows, labels = labelled_texts(4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdicts, cutoffs = quality.judge(docs, marks)
    assert {(r.stratum, r.measure) for r in cutoffs.collect()} >= {
        ("en", "symbols_per_word"),
        ("fr", "symbols_per_word"),
    }
    for row in cutoffs.collect():
        assert row.bound_p <= quality.DELTA / 8
    junk = {i for i, q, _ in labels if q == 0}
    for row in verdicts.collect():
        assert row.kept == (row.doc_id not in junk)


def test_few_labels_certify_nothing(spark):
    rows, labels = labelled_texts(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    verdicts, cutoffs = quality.judge(docs, marks)
    assert cutoffs.count() == 0
    assert all(r.kept for r in verdicts.collect())


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clashing = odd_documents.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    rows = quality.judge(clashing, labels)[0].collect()
    assert len(rows) == odd_documents.count()
    by_text = {found(r) for r in rows}
    assert by_text == {counts(r.text) for r in odd_documents.collect()}
    assert quality.judge(no_documents, labels)[0].collect() == []
    named = odd_documents.withColumns({"word": F.lit(1), "places": F.lit(2), "n_lines": F.lit(3)})
    counted = quality.base_counts(named)
    assert {*named.columns, *quality.COUNTS} == set(counted.columns)
    assert {(r.word, r.places) for r in counted.collect()} == {(1, 2)}


def test_no_python_on_the_way(spark):
    plan = QUERIES["op2_quality"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
