"""The corpus pipeline: stages of ``marquee.llm`` applied one after another to the documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm import bpe, langid, line_dedup, mixing, near_dup
from marquee.llm.common import STORED, WORD, discard, prepare, store, unused
from marquee.llm.queries import RANKS, SEED, learnable

#: Least share of a document's letters in its main language.
LEAST_SCORE = 1 / 3
#: Columns of documents that stages work with.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeps_columns(stage: Stage) -> Stage:
    """A stage that sees other columns than DOCUMENT under names that nothing clashes with, and
    returns the columns it was given."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"other_column_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        found = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        return found.withColumnsRenamed({v: k for k, v in hidden.items()}).select(*docs.columns)

    return run


@keeps_columns
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear main language, which becomes their ``lang``.

    Rejected are texts that are null or without a letter, and those of which no language labels
    LEAST_SCORE of the letters. Models are learnt from the labelled documents of ``docs``.
    """
    prepare(spark)
    model = langid.fit(docs.where(learnable()))
    found = langid.identify(docs, model)
    clear = (F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= LEAST_SCORE)
    return found.where(clear).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@keeps_columns
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows removed; ``n_chars`` follows the text.

    A document of which that leaves no word goes. Null, empty and wordless texts have no lines and
    stay as they are; repeated rows (equal id and text) are one document and lose the same lines.
    """
    prepare(spark)
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    counted = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.where(~emptied).withColumn("n_chars", counted.cast("long")).select(*docs.columns)


@keeps_columns
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id.

    A text that repeats under the same id, or without one, stays once: of its rows the one that
    is least in the other columns.
    """
    prepare(spark)
    own, text_hash, copies, place = unused(docs, "own", "text_hash", "copies", "place")
    kept = (
        near_dup.classes(docs)
        .where("kept")
        .groupBy("class", F.col("doc_id").alias(own), F.col("print").alias(text_hash))
        .agg(F.count("*").alias(copies))
    )
    one = kept.groupBy("class").agg(F.min(F.struct(own, text_hash, copies)).alias("one")).select("one.*")
    one = store(one, "near-dup-kept")
    same = docs["doc_id"].eqNullSafe(one[own]) & (F.xxhash64(docs["text"]) == one[text_hash])
    single = docs.join(one.where(one[copies] == 1), same).select(*[docs[c] for c in docs.columns])
    others = [c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]
    order = Window.partitionBy(own, text_hash).orderBy(*others)
    repeated = (
        docs.join(one.where(one[copies] > 1), same)
        .withColumn(place, F.row_number().over(order))
        .where(F.col(place) == 1)
        .select(*docs.columns)
    )
    return single.unionByName(repeated)


@keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks for.

    Documents without a word take no share and are not in the mix; documents without a source
    are a source of their own. Repeated rows count as often as they come.
    """
    prepare(spark)
    return mixing.training_order(mixing.mix(docs, SEED), docs.columns).drop("position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text.

    A null or empty text has no ids. Every row is encoded, repeated ones too; other columns than
    those named are left out.
    """
    prepare(spark)
    docs = docs.select("doc_id", "text", "lang", "source")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == whole).alias("round_trip"),
    )


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("BPE", encode),
]
#: SQL expresses neither the language models nor the merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, the result of each written before the next reads it.

    What a stage stored on its way, and what it read, is deleted as soon as its result is written.
    """
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    since = len(STORED)
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "pipeline")
        discard(spark, since, but=STORED[-1:])
    return STAGES[-1][1](spark, docs, sf_dir)
