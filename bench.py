"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm wall time, median of three.

Names ending in ``_published`` are reports over a fact that was published before, the others
start from the raw tables.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.operators import reports
from marquee.plans.load import load_fact, recent_revenue
from marquee.queries import AS_OF, QUERIES
from marquee.session import configure
from marquee.sources.snapshots import read_fact
from marquee.sources.trade_tables import TradeTables, read_table

HEADLINE = [
    "fact_bookings",
    "mv_daily_revenue",
    "mv_movie_performance",
    "mv_timeslot_analysis",
    "analytics_summary",
    "daily_revenue",
    "seat_map",
    "admit_bookings",
    "latency_summary",
]
PUBLISHED = {
    "mv_daily_revenue": reports.mv_daily_revenue,
    "mv_movie_performance": reports.mv_movie_performance,
    "mv_timeslot_analysis": reports.mv_timeslot_analysis,
    "analytics_summary": reports.analytics_summary,
}
WARMUPS, RUNS = 2, 3


def run_once(make: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def headline(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """What is measured, by name."""
    made = {name: (lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    path = f"{tempfile.mkdtemp(prefix='marquee-bench-')}/fact"
    model = TradeTables(configure(spark), sf_dir).booking_model()
    made["load_fact"] = lambda: load_fact(spark, model, path)
    for name, report in PUBLISHED.items():
        made[f"{name}_published"] = lambda report=report: report(read_fact(spark, path))
    made["daily_revenue_published"] = lambda: recent_revenue(spark, path, AS_OF)
    return made


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marquee-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = {"latency_summary": ["events"]}
    sizes = {t: read_table(spark, sf_dir, t).count() for t in ("orders", "lineitem", "events")}
    made, seconds, rate = headline(spark, sf_dir), {}, {}
    for _ in range(WARMUPS):
        for make in made.values():
            run_once(make)
    for name, make in made.items():
        seconds[name] = round(statistics.median(run_once(make) for _ in range(RUNS)), 3)
        if not name.endswith("_published"):
            read = sum(sizes[t] for t in tables.get(name, ["orders", "lineitem"]))
            rate[name] = round(read / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "input_rows_per_sec": rate,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
