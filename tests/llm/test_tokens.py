"""Encoding, decoding and counting against the libraries."""

from __future__ import annotations

import hashlib
import json
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import bpe, token_counts
from marquee.llm.queries import QUERIES, RANKS, TOKENIZER

PATTERN = public_tokenizers.PATTERN
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return bpe.TreeCodec(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.parse_ranks(bpe.read_ranks(RANKS))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    with open(TOKENIZER, encoding="utf-8") as file:
        return token_counts.TokenCounter(json.load(file))


def some_texts(n: int):
    draw = random.Random(5)
    letters = "abcdefgh  \n\t  .,'#ßñéthe ing日本語12ا́½Ⅷ👍"
    for i in range(n):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(120)))
        if i % 4 == 0:
            text = draw.choice(["a", "ab", "=", "- ", " ", "\n", "é", "0"]) * draw.randrange(300) + text
        yield text + ("<|endoftext|>" + text if i % 5 == 0 else "")


def test_same_ids_as_the_library_and_back(codec, library):
    for text in some_texts(1500):
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_code_point_is_split_alike(codec, library, counter, tokenizer):
    for code in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x1FA00, 5)]:
        c = chr(code)
        text = f"a{c}b {c}{c} 1{c}  {c}."
        assert codec.encode(text).tolist() == library.encode_ordinary(text), hex(code)
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_cutting_a_long_text_changes_nothing(codec, library, monkeypatch):
    for text in some_texts(300):
        assert "".join(bpe.leaves(text, 7)) == text
        pieces = [i for leaf in bpe.leaves(text, 7) for i in codec.encode(leaf).tolist()]
        assert pieces == library.encode_ordinary(text)
    monkeypatch.setattr(bpe, "LEAF_IDS", 3)
    assert codec.decode(codec.encode("a tree of several ids")) == b"a tree of several ids"


def test_counts_as_the_library(counter, tokenizer):
    for text in some_texts(1500):
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_proven_strings_are_one_token(counter, tokenizer):
    assert len(counter.whole) > 49_000
    for text in random.Random(3).sample(sorted(counter.whole), 3000):
        assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1


def test_other_kinds_of_file_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        with pytest.raises(ValueError):
            token_counts.TokenCounter(json.load(file))


def test_queries_on_all_documents(spark, library, tokenizer):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    for row in QUERIES["op1_bpe"](spark, SMALL).collect():
        text = texts[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    counted = QUERIES["op9_token_counts"](spark, SMALL).collect()
    assert len(counted) == len(texts)
    for row in counted:
        text = texts[row.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512)


def test_odd_rows(odd_documents, no_documents, library, tokenizer):
    clashing = odd_documents.withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    out = bpe.decode(bpe.encode(clashing, RANKS, PATTERN), RANKS)
    out = token_counts.count_tokens(out, TOKENIZER)
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    for row in rows:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
        assert row.n_tokens == len(tokenizer.encode(row.text or "", add_special_tokens=False).ids)
    empty = bpe.decode(bpe.encode(no_documents, RANKS, PATTERN), RANKS)
    assert token_counts.count_tokens(empty, TOKENIZER).collect() == []
