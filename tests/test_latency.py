from __future__ import annotations

import random

import numpy as np
import pytest

from marquee.operators import latency
from marquee.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("kind", ["spread", "ties", "signs", "single", "close", "wide"])
def test_quantiles_match_the_sorted_list(spark, kind):
    rng = random.Random(9)
    values = {
        "spread": [rng.lognormvariate(3, 2) for _ in range(3000)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 50.0]) for _ in range(1000)],
        "signs": [rng.uniform(-5, 5) for _ in range(500)] + [0.0] * 40,
        "single": [7.5],
        "close": [1000 * (1 + n * 2.0**-52) for n in range(700)],  # neighbouring numbers
        "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(600)] + [-1e308, 1e308],
    }[kind]
    data = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    counts = data.groupBy("g", "v").count()
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(counts, "g", "v", "count", wanted).first()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_summary_and_targets(spark):
    samples = [(1000.0 * i, 100.0 + i, "book", i != 3) for i in range(10)]
    samples += [(500.0, 9000.0, "slow", True)]
    log = spark.createDataFrame(samples, "started_ms double, elapsed_ms double, label string, success boolean")
    got = {r["label"]: r for r in latency.latency_summary(log).collect()}
    assert set(got) == {"book", "slow", "TOTAL"}
    assert got["book"]["error_rate"] == 0.1 and got["TOTAL"]["samples"] == 11
    assert got["book"]["throughput_per_s"] == pytest.approx(10 / 9.109, abs=1e-6)
    assert got["book"]["p90_ms"] == pytest.approx(108.1)
    checks = {r["label"]: r for r in latency.sla_check(log).collect()}
    assert checks["book"]["avg_ok"] and not checks["book"]["errors_ok"] and not checks["slow"]["p95_ok"]
    assert not checks["book"]["all_ok"]
    assert [r["label"] for r in latency.slowest_labels(log, 1).collect()] == ["slow"]
