"""Load-test result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import REQUEST_LOG, REQUEST_LOG_NEEDED


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Read result logs in CSV form, mapping columns by the names in the header.

    The listener decides which columns a log has and in which order; those it leaves out are
    null. A header with an unknown name, or without one of the columns every report needs, is an
    error, as is a file whose header differs from the first one's.
    """
    names = spark.read.option("header", True).csv(path).columns
    known = REQUEST_LOG.fieldNames()
    unknown = [n for n in names if n not in known]
    missing = [n for n in REQUEST_LOG_NEEDED if n not in names]
    if unknown or missing:
        raise ValueError(f"not a result log: unknown columns {unknown}, missing columns {missing}")
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    log = spark.read.schema(layout).option("header", True).option("enforceSchema", False).csv(path)
    return log.select(
        *[
            (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in REQUEST_LOG.fields
        ]
    )


def as_samples(log: DataFrame) -> DataFrame:
    """The columns the latency operators use."""
    return log.select(
        F.col("timeStamp").cast("double").alias("started_ms"),
        F.col("elapsed").cast("double").alias("elapsed_ms"),
        "label",
        "success",
    )
