from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
PASSAGE = "\n".join(f"line {i} of a passage that many texts share word{i}" for i in range(5))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Nulls, empty and long texts, equal texts, repeated rows, marks and scripts of many kinds.
ODD_ROWS = [
    (1, "The quick brown fox, it's 42!\n\nJumps  over\tthe lazy dog.", "en", "a", 50),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b\x0c\r ", "fr", "b", 7),
    (5, "naïve café — Ωμέγα привет 東京 نص 👩‍👩‍👧 é  x", None, "b", 40),
    (6, LONG, "en", "c", len(LONG)),
    (7, PASSAGE, "en", "c", len(PASSAGE)),
    (8, "own words first\n" + PASSAGE + "\nown words last", "en", None, 1),
    (8, "own words first\n" + PASSAGE + "\nown words last", "en", None, 1),
    (9, PASSAGE, "en", "a", len(PASSAGE)),
    (None, "a row without an id " * 20, "de", "a", 400),
    (None, None, None, None, None),
    (10, "<|endoftext|> text <|endoftext|><|endoftext|>", "en", "a", 40),
    (11, "=" * 3000 + " " * 50 + "a" * 3000, "en", "b", 6050),
    (12, "one two", "en", "b", 7),
    (13, "one two", "en", "b", 7),
]


@pytest.fixture
def odd_documents(spark):
    from marquee.llm.common import prepare

    return prepare(spark).createDataFrame(ODD_ROWS, DOCUMENTS)


@pytest.fixture
def no_documents(spark):
    from marquee.llm.common import prepare

    return prepare(spark).createDataFrame([], DOCUMENTS)
