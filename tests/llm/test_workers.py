"""Executors need no copy of the package: what their workers run travels with the job."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

spark = (
    SparkSession.builder.master("local[4]")
    .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")


@F.udf("boolean")
def importable(_):
    import importlib.util
    return importlib.util.find_spec("marquee") is not None


assert not spark.range(1).select(importable("id")).first()[0]
from marquee.llm.queries import QUERIES

for name in sorted(QUERIES):
    if name.split("_")[0] in {names!r}:
        QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_workers_that_cannot_import_the_package(tmp_path):
    names = {"op1", "op3", "op4", "op5", "op7", "op9", "op11", "op12", "op13"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=str(REPO), names=names)],
        cwd=tmp_path, capture_output=True, text=True, timeout=600,
    )
    assert done.stdout.count("ran ") == len(names), done.stdout + done.stderr[-3000:]
