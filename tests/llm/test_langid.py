"""Language identification: spans, scripts, the exact path, and accuracy on held-out documents."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import langid
from marquee.llm.common import prepare
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
EN = "the quick brown fox jumps over the lazy dog and then it goes home with the other foxes"
FR = "le renard brun saute par dessus le chien paresseux et puis il rentre chez lui avec les autres"
RU = "быстрая лиса прыгает через ленивую собаку и потом идет домой вместе с другими лисами"


def model(spark):
    rows = [(i, text, lang) for i in range(5) for text, lang in ((EN, "en"), (FR, "fr"), (RU, "ru"))]
    return langid.fit(prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string"))


def test_path_is_the_best_of_all():
    draw = np.random.default_rng(1)
    for _ in range(300):
        n, k = draw.integers(1, 7), draw.integers(1, 4)
        scores = draw.normal(scale=4, size=(n, k))
        value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - 5 * sum(
            a != b for a, b in zip(p, p[1:])
        )
        best = max(map(value, itertools.product(range(k), repeat=int(n))))
        assert np.isclose(value(langid.viterbi(scores, 5.0)), best)


def test_spans_of_a_mixed_text(spark):
    labeller = langid.Labeller(model(spark))
    lang, score, spans = labeller.label(f"{EN} {EN} {FR} {RU}")
    assert [s[2] for s in spans] == ["en", "fr", "ru"]
    n = len(EN.split())
    assert [s[:2] for s in spans][0] == (0, 2 * n)
    assert lang == "en" and 0.4 < score < 0.6


def test_script_narrows_candidates(spark):
    found = model(spark)
    scores, letters = found.words(["Собака,", "日本", "1.5", "naïve"])
    assert letters.tolist() == [6, 2, 0, 5]
    assert found.languages[int(scores[0].argmax())] == "ru"
    assert scores[0, found.languages.index("en")] == 6 * langid.OUTSIDE
    assert not scores[1].any() and not scores[2].any()
    assert scores[3].argmax() != found.languages.index("ru")


def test_letters_keep_their_edges():
    a, b = langid.letters_of(["ab", "x1ab"]), langid.letters_of(["ab"])
    assert a.token.tolist() == [0, 0, 1, 1, 1]
    assert a.cell[:2].tolist() == b.cell.tolist() == a.cell[3:].tolist()


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_langid"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_odd_rows(spark, odd_documents, no_documents):
    clashing = odd_documents.withColumn("lang_pred", F.lit(1)).withColumn("rank", F.lit(2))
    rows = langid.identify(clashing, model(spark)).collect()
    assert len(rows) == odd_documents.count()
    for row in rows:
        lettered = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred != "und") == lettered
        assert row.lang_pred in ("en", "fr", "ru", "und")
    unknown = langid.fit(no_documents)
    assert {r.lang_pred for r in langid.identify(odd_documents, unknown).collect()} == {"und"}
    assert langid.identify(no_documents, unknown).collect() == []


def test_letters_that_no_language_has_score_nothing(spark):
    labeller = langid.Labeller(model(spark))
    for text in ("這是一個沒有學過的語言", "ภาษาไทย ไม่มี ใครรู้"):
        lang, score, spans = labeller.label(text)
        assert lang in labeller.model.languages and score == 0.0 and spans
    lang, score, _ = labeller.label(f"{EN} 日本")
    letters = sum(map(str.isalpha, EN))
    assert lang == "en" and score == letters / (letters + 2)
    docs = prepare(spark).createDataFrame([(1, "這是一個沒有學過的語言"), (2, EN)], "doc_id long, text string")
    assert {r.doc_id: r.lang_score for r in langid.identify(docs, labeller.model).collect()} == {1: 0.0, 2: 1.0}
