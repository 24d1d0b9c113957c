"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, conversations, langid, line_dedup, mixing, near_dup, neighbours, quality, sharding, templates, token_counts, votes
from .common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512
SEED = 7
SHARDS = 8
NEIGHBOURS = 10
CENTROIDS, CENTROID_ROUNDS, CENTROID_DIM, CENTROID_SEED = 40, 5, 64, 2


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _text_size() -> Column:
    """UTF-8 bytes of the text, 0 for null."""
    return F.octet_length(F.coalesce("text", F.lit(""))).cast("long")


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    verdicts, _ = quality.judge(docs, read(spark, sf_dir, "labels"))
    return verdicts.drop("lang")


@_query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), NEIGHBOURS, SEED)


@_query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return templates.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def learnable() -> Column:
    """Whether language models may learn from a document (fixed by the contract)."""
    return ~held_out() & F.col("lang").isNotNull()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@_query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(learnable()))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_spans").alias("spans"),
    )


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@_query
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "kept")


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which training first comes to them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, SEED).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.round(F.get("positions", F.lit(0)), 9).alias("first_position"),
        F.array_join(
            F.transform("positions", lambda p: F.round(p * 1e6).cast("long").cast("string")), ","
        ).alias("positions_millionths"),
    )
    return mixing.in_time(mixed, "first_position")


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, TOKENIZER).select(
        "doc_id",
        _text_size().alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (_text_size() + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return sharding.shard(rows, SHARDS, SEED).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    marks = read(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    model = votes.fit(docs.where(~held_out), marks.where("label = most"))
    scored = votes.classify(docs.withColumn("held_out", held_out), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, turns = conversations.repair(conversations.damage(rows))
    named = lambda df: df.withColumn("key", conversations.conversation(F.col("conv_id")))
    every = named(rows.select("conv_id").distinct())
    found = every.join(named(summary).drop("conv_id"), "key", "left")
    found = found.join(conversations.digests(turns), "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(
        "conv_id",
        *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@_query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, CENTROIDS, CENTROID_ROUNDS, CENTROID_DIM, CENTROID_SEED)
