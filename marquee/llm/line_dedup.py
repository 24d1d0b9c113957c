"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text (of those that hold a word) are hashed together. A
window that occurs in several places is kept where it occurs first, by document id, text and
place; at all later places its lines are covered. Covered places of a text are merged, and its
lines there are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

WINDOW = 3
#: ASCII white space at the ends of a line does not count.
BLANKS = " \t\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(lines: Column) -> Column:
    """Indexes of the lines that hold a word."""
    indexed = F.transform(lines, lambda line, i: F.when(F.btrim(line, F.lit(BLANKS)) != "", i))
    return F.filter(indexed, lambda i: i.isNotNull())


def repeated_windows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Later places of repeated windows: (key, print, places).

    ``print`` is a hash of the text and tells rows of one key apart; ``places`` counts the
    worded lines from 0 and lists where later windows start.
    """
    lines = df.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("print"), _lines(F.col(text)).alias("lines")
    )
    worded = lines.withColumn("at", _worded(F.col("lines"))).where(F.size("at") >= WINDOW)
    line = lambda i: F.btrim(F.get("lines", F.get("at", i)), F.lit(BLANKS))
    window = lambda i: F.struct(  # noqa: E731  128 bits
        i.alias("place"),
        F.xxhash64(*[line(i + k) for k in range(WINDOW)]).alias("h1"),
        F.xxhash64(F.lit(1), *[line(i + k) for k in range(WINDOW)]).alias("h2"),
    )
    starts = F.sequence(F.lit(0), F.size("at") - WINDOW)
    windows = worded.select("key", "print", F.inline(F.transform(starts, window)))
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("key", "print", "place")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return (
        windows.join(first, ["h1", "h2"])
        .where(F.struct("key", "print", "place") != F.col("first"))
        .groupBy("key", "print")
        .agg(F.collect_set("place").alias("places"))  # of one text
    )


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Remove later occurrences of repeated three-line windows from ``text``.

    Adds ``n_lines`` and ``n_removed`` (long, of the lines that hold a word); these names are
    replaced, other columns stay. Lines without a word stay and are not counted. A null text
    stays null and an empty one empty, both with 0 lines. Texts of fewer than three lines keep
    all. Null keys come first. Rows that agree in key and text are one document and get the
    same result. An empty table gives an empty result.
    """
    df = df.drop("n_lines", "n_removed")
    columns = df.columns
    own, own_print, places, lines, at, covered = unused(
        df, "own", "print", "places", "lines", "at", "covered"
    )
    found = repeated_windows(df, text, key)
    found = found.select(
        F.col("key").alias(own), F.col("print").alias(own_print), F.col("places").alias(places)
    )
    same = df[key].eqNullSafe(found[own]) & (F.xxhash64(df[text]) == found[own_print])
    joined = (
        df.join(found, same, "left")
        .select(*[df[c] for c in columns], places)
        .withColumn(lines, F.coalesce(_lines(F.col(text)), F.array().cast("array<string>")))
        .withColumn(at, _worded(F.col(lines)))
        .withColumn(
            covered,
            F.array_distinct(
                F.flatten(F.transform(places, lambda p: F.slice(F.col(at), p + 1, WINDOW)))
            ),
        )
    )
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    rest = F.transform(F.array_except(every, F.col(covered)), lambda i: F.get(F.col(lines), i))
    return joined.select(
        *[c for c in columns if c != text],
        F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")).alias(text),
        F.size(at).cast("long").alias("n_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"),
    ).select(*columns, "n_lines", "n_removed")
