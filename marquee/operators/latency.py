"""Load-test report over a request log (started_ms, elapsed_ms, label, success)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .quantiles import exact_quantiles

OVERALL = "TOTAL"

# Service targets in milliseconds, requests per second and share of errors.
MAX_AVG_MS, MAX_P90_MS, MAX_P95_MS = 500.0, 1000.0, 2000.0
MIN_THROUGHPUT, MAX_ERROR_RATE = 100.0, 0.01


def latency_summary(log: DataFrame) -> DataFrame:
    """Per label and overall: samples, latency, percentiles, error rate, throughput.

    The log is read once and reduced to one row per (label, elapsed), which is stored; everything
    else, the overall row included, works on those counts. Throughput is samples over the time
    from the first start to the last end.
    """
    ensure_checkpoint_dir(log.sparkSession)
    counts = (
        log.groupBy("label", "elapsed_ms")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("success")).alias("errors"),
            F.min("started_ms").alias("first_start"),
            F.max(F.col("started_ms") + F.col("elapsed_ms")).alias("last_end"),
        )
        .checkpoint()
    )
    # every row counts for its label and for the overall one
    labels = F.explode(F.array("label", F.lit(OVERALL)))
    both = counts.select(labels.alias("label"), *[c for c in counts.columns if c != "label"])
    seconds = (F.max("last_end") - F.min("first_start")) / F.lit(1000.0)
    samples = F.sum("n")
    basics = both.groupBy("label").agg(
        samples.alias("samples"),
        (F.sum(F.col("elapsed_ms") * F.col("n")) / samples).alias("avg_ms"),
        F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        (F.sum("errors") / samples).alias("error_rate"),
        F.try_divide(samples.cast("double"), seconds).alias("throughput_per_s"),
    )
    tails = exact_quantiles(both, "label", "elapsed_ms", "n", {"p90_ms": 0.9, "p95_ms": 0.95})
    tails = tails.withColumnRenamed("label", "of")
    return basics.join(tails, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "label",
        "samples",
        F.round("avg_ms", 6).alias("avg_ms"),
        "min_ms",
        "max_ms",
        F.round("p90_ms", 6).alias("p90_ms"),
        F.round("p95_ms", 6).alias("p95_ms"),
        F.round("error_rate", 6).alias("error_rate"),
        F.round("throughput_per_s", 6).alias("throughput_per_s"),
    )


def sla_check(log: DataFrame) -> DataFrame:
    """Which service targets each label meets."""
    checks = {
        "avg_ok": F.col("avg_ms") < MAX_AVG_MS,
        "p90_ok": F.col("p90_ms") < MAX_P90_MS,
        "p95_ok": F.col("p95_ms") < MAX_P95_MS,
        "throughput_ok": F.col("throughput_per_s") > MIN_THROUGHPUT,
        "errors_ok": F.col("error_rate") < MAX_ERROR_RATE,
    }
    rows = latency_summary(log).select("label", *[c.alias(name) for name, c in checks.items()])
    everything = F.lit(True)
    for name in checks:
        everything = everything & F.col(name)
    return rows.withColumn("all_ok", everything)


def slowest_labels(log: DataFrame, n: int = 10) -> DataFrame:
    return (
        log.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.round(F.sum("elapsed_ms"), 6).alias("total_ms"),
            F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"),
            F.max("elapsed_ms").alias("max_ms"),
        )
        .orderBy(F.desc("total_ms"), "label")
        .limit(n)
    )
