"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts come from every whole text. On them stand rules of the form "measure above cutoff".
Cutoffs are not chosen by hand: labelled documents that pass the base rules are a holdout, on
which nothing is fitted. For each stratum and measure the cutoffs of a fixed grid are tested from
the mildest to the strictest, each against the hypothesis that it rejects more than its share
of good documents, by the exact binomial tail; testing stops at the first that fails (fixed
sequence). Stratum and measure share the error level equally (Bonferroni). So with probability
1 - DELTA no stratum loses more than RISK of its good documents to all rules together. Among the
certified cutoffs the one that tells junk from good best is taken, none if none does: choosing
among them afterwards is free, as the bounds hold for all at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, store, unused, words

#: Good documents that all rules together may reject, as a share of each stratum.
RISK = 0.05
#: Probability with which that may fail for any stratum.
DELTA = 0.05
#: Among certified cutoffs, a good document lost weighs as much as so many pieces of junk caught.
COST = 10
#: Shortest document, and the share of words in repeated windows that fails (fixed by contract).
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Terms of a binomial tail that are added up; a bound on the rest is added to them.
TAIL_TERMS = 5_000
#: Measures and their cutoffs, mildest first.
GRIDS = {
    "symbols_per_word": [round(3.0 * 0.9**i, 6) for i in range(48)],
    "duplicate_lines": [round(0.9 - 0.02 * i, 6) for i in range(44)],
    "repeated_words": [round(0.5 - 0.01 * i, 6) for i in range(48)],
    "long_words": [round(40 * 0.95**i, 6) for i in range(40)],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of ``text`` as long columns, and ``n_lines`` (lines with a word).

    A null or empty text counts 0 everywhere. Columns of these names are replaced.
    """
    df = df.drop(*COUNTS, "n_lines")
    columns = df.columns
    word, line, tagged, bits, places = unused(df, "word", "line", "tagged", "bits", "places")
    whole = F.coalesce(F.col(text), F.lit(""))
    split = df.withColumns(
        {
            word: words(F.col(text)),
            line: F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    counted = split.select(
        *columns,
        "n_symbols",
        F.size(word).cast("long").alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        F.size(line).cast("long").alias("n_lines"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
        _tagged_windows(F.col(word)).alias(tagged),
        _place_bits(F.col(word)).alias(bits),
    )
    placed = counted.withColumn(places, _repeated_places(F.col(tagged), F.col(bits)))
    return placed.withColumn("n_repeat_words", _covered(F.col(places))).select(
        *columns, *COUNTS, "n_lines"
    )


def _place_bits(word: Column) -> Column:
    """Bits that hold any place in the array of words."""
    return F.length(F.bin(F.size(word)))


def _tagged_windows(word: Column) -> Column:
    """For each window of three words its hash, with its place in the low bits, in order.

    Sorting whole numbers puts equal windows side by side. A text of n words leaves 64 - log2(n)
    bits of hash, 49 for the longest of 20,000 words.
    """
    low = F.call_function("shiftleft", F.lit(1).cast("long"), _place_bits(word)) - 1
    one = lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))
    tagged = F.transform(
        F.sequence(F.lit(0), F.size(word) - 3),
        lambda i: one(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(word) >= 3, F.sort_array(tagged)).otherwise(F.array().cast("array<bigint>"))


def _repeated_places(tagged: Column, bits: Column) -> Column:
    """Places of windows with the same hash as another, in order."""
    print_at = lambda i: F.call_function("shiftright", F.get(tagged, i), bits)
    twin = F.filter(
        tagged,
        lambda x, i: F.coalesce(F.call_function("shiftright", x, bits) == print_at(i + 1), F.lit(False))
        | F.coalesce(F.call_function("shiftright", x, bits) == print_at(i - 1), F.lit(False)),
    )
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.sort_array(F.transform(twin, lambda x: x.bitwiseAND(low)))


def _covered(places: Column) -> Column:
    """Words in any of the windows of three at ``places``: each adds what the next leaves it."""
    steps = F.transform(
        places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(3)), F.lit(3))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def measures() -> dict[str, Column]:
    """The measures of GRIDS from the base counts."""
    per = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "duplicate_lines": per("n_dup_lines", "n_lines"),
        "repeated_words": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
    }


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """ln(n!): exact to 20, Stirling's series beyond (error below 1e-13)."""
    x = n.cast("double")
    series = (
        (x + 0.5) * F.log(x)
        - x
        + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x)
        - 1 / (360 * x * x * x)
        + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(
        series
    )


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), exact but for an upper bound on terms that are next to nothing.

    Terms are added from k downwards, each the one before times i * (1 - risk) / ((n - i + 1) * risk),
    in units of the first. From n * risk on the tail is past the middle and 1 is returned, which
    certifies nothing.
    """
    n, k = n.cast("double"), k.cast("double")
    first = (
        _log_factorial(n)
        - _log_factorial(k)
        - _log_factorial(n - k)
        + k * math.log(risk)
        + (n - k) * math.log1p(-risk)
    )
    ratio = lambda i: i * (1 - risk) / ((n - i + 1) * risk)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(sofar: Column, j: Column) -> Column:
        term = sofar["term"] * F.greatest(ratio(k - j), F.lit(0.0))
        return F.struct(term.alias("term"), (sofar["total"] + term).alias("total"))

    added = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(float(TAIL_TERMS))).cast("int")), zero, step
    )
    last = F.greatest(ratio(k - TAIL_TERMS), F.lit(0.0))
    rest = F.when(k > TAIL_TERMS, added["term"] * last / F.greatest(1 - last, F.lit(1e-12))).otherwise(0.0)
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(first) * (added["total"] + rest))


def _cutoffs_below(value: Column, grid: list[float]) -> Column:
    """Number of cutoffs that the value lies above; the strictest are last in a grid."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda cutoff: value > cutoff))


def calibrate(labelled: DataFrame) -> DataFrame:
    """Cutoffs from (stratum, good boolean, measures): one row per stratum and measure.

    Columns: stratum, measure, cutoff, n_good, n_rejected, n_junk, n_caught, bound_p. Only pairs with a certified
    cutoff that rejects junk at a higher rate than good documents are returned.
    """
    named = [
        F.struct(
            F.lit(name).alias("measure"),
            _cutoffs_below(F.col(name), grid).alias("above"),
            F.lit(len(grid)).alias("steps"),
        )
        for name, grid in GRIDS.items()
    ]
    levels = (
        labelled.select("stratum", "good", F.inline(F.array(*named)))
        .groupBy("stratum", "measure", "steps", "above")
        .agg(
            F.sum(F.col("good").cast("long")).alias("good"),
            F.sum((~F.col("good")).cast("long")).alias("junk"),
        )
    )
    # A value that lies above the j strictest cutoffs is rejected by the last j of the grid.
    at_step = levels.groupBy("stratum", "measure", "steps").agg(
        F.collect_list(F.struct("above", "good", "junk")).alias("levels"),  # one per cutoff at most
        F.sum("good").alias("n_good"),
        F.sum("junk").alias("n_junk"),
    )
    count = lambda kind, step: F.aggregate(
        F.filter("levels", lambda x: x["above"] >= F.col("steps") - step),
        F.lit(0).cast("long"),
        lambda total, x: total + x[kind],
    )
    share = RISK / len(GRIDS)
    each = at_step.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("step")
    ).select(
        "stratum",
        "measure",
        "step",
        "n_good",
        "n_junk",
        count("good", F.col("step")).alias("n_rejected"),
        count("junk", F.col("step")).alias("n_caught"),
    )
    number = Window.partitionBy()
    strata = F.size(F.collect_set(F.struct("stratum")).over(number))
    ordered = Window.partitionBy("stratum", "measure").orderBy("step")
    best = Window.partitionBy("stratum", "measure").orderBy(F.desc("gain"), "step")
    cutoff = F.element_at(
        F.create_map(*[x for name, grid in GRIDS.items() for x in (F.lit(name), F.lit(grid))]), F.col("measure")
    )
    return (
        each.withColumn("tests", strata * len(GRIDS))
        .withColumn("bound_p", binomial_tail(F.col("n_rejected"), F.col("n_good"), share))
        .withColumn("safe", F.min((F.col("bound_p") <= DELTA / F.col("tests")).cast("int")).over(ordered))
        .where("safe = 1")
        .withColumn(
            "gain",
            F.col("n_caught") / F.greatest("n_junk", F.lit(1))
            - COST * F.col("n_rejected") / F.greatest("n_good", F.lit(1)),
        )
        .where("gain > 0")
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select(
            "stratum",
            "measure",
            F.get(cutoff, F.col("step")).alias("cutoff"),
            "n_good",
            "n_rejected",
            "n_junk",
            "n_caught",
            "bound_p",
        )
    )


def judge(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Verdicts of ``docs`` and the certified cutoffs, by ``labels`` (key, quality 0 or 1).

    Verdicts: one row per row of ``docs`` with key, stratum, the base counts, ``base_failed`` and
    ``kept``. A null text counts 0 words and fails. Labels that are null, contradict each other or
    name no document are left out; without labels nothing is certified and the base rules alone
    decide. Null is a stratum of its own. Rows with a repeated key count each for themselves.
    """
    counted = base_counts(
        docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    ).drop("text")
    counted = store(counted.withColumns(measures()).withColumn("base_failed", base_failed()), "quality")
    quality = F.col("quality")
    known = (
        labels.where(quality.isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("doc_id"))
        .agg(F.min(quality).alias("least"), F.max(quality).alias("most"))
        .where("least = most")
        .select("doc_id", (F.col("least") > 0).alias("good"))
    )
    cutoffs = store(calibrate(counted.where("not base_failed").join(known, "doc_id")), "quality-cutoffs")
    rules = cutoffs.groupBy(F.col("stratum").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("rules")
    )
    broken = F.lit(False)
    for name in GRIDS:
        broken = broken | F.coalesce(F.col(name) > F.try_element_at("rules", F.lit(name)), F.lit(False))
    verdicts = counted.join(rules, F.col("stratum").eqNullSafe(F.col("of")), "left").select(
        F.col("doc_id").alias(key),
        F.col("stratum").alias(stratum),
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & ~broken).alias("kept"),
    )
    return verdicts, cutoffs
