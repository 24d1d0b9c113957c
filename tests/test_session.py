from __future__ import annotations

from pathlib import Path

from marquee.session import SETTINGS, configure, ensure_checkpoint_dir

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_settings_and_partition_count(spark):
    try:
        configure(spark, shuffle_bytes=1 << 40)
        assert int(spark.conf.get(INITIAL)) == 8192
        assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())
    finally:
        spark.conf.unset(INITIAL)
    configure(spark, shuffle_bytes=1)
    assert spark.conf.get(INITIAL, None) is None


def test_the_configured_checkpoint_folder_is_used(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir() == ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert Path(configured).name in folder


def test_no_local_checkpoints_and_no_broadcast_hints():
    code = "".join(p.read_text() for p in Path(__file__).parents[1].glob("marquee/**/*.py"))
    for word in ("localCheckpoint", "F.broadcast(", ".crossJoin(", ".toPandas(", ".rdd"):
        assert word not in code
