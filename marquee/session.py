"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: everything here can be set on a session that already exists.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: let AQE split an oversized join partition even if that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A union that keeps its inputs' partitioning zips their partitions, and fails where AQE has
    # left one input with fewer.
    "spark.sql.unionOutputPartitioning": "false",
}


# Size of shuffle partitions to aim for, and shuffle partitions per core at least.
PARTITION_BYTES = 128 * 1024 * 1024
PARTITIONS_PER_CORE = 4


def configure(spark: SparkSession, shuffle_bytes: int = 0) -> SparkSession:
    """Apply the settings and let shuffles start with enough partitions.

    ``shuffle_bytes`` is the expected size of the largest shuffle. AQE merges partitions that
    turn out small, but it cannot divide those of an aggregate, so the start must be high.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    partitions = math.ceil(shuffle_bytes / PARTITION_BYTES)
    if not sc.master.startswith("local"):
        partitions = max(partitions, PARTITIONS_PER_CORE * sc.defaultParallelism)
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    The folder a cluster names in ``spark.checkpoint.dir`` always wins. Only a local
    session without one gets a temporary folder; a cluster session without one is an
    error, because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="marquee-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder: made once, read by column, of known size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
