"""The load job, and reports over the fact it published."""

from __future__ import annotations

from datetime import date

from cinema import BASE, at, hold, money
from frames import rows

from marquee.operators import reports
from marquee.plans.fact import FACT_COLUMNS, fact_bookings
from marquee.plans.load import load_fact, recent_revenue
from marquee.sources.snapshots import read_fact


def test_load_and_reports(spark, make_model, tmp_path):
    path = str(tmp_path / "fact")
    days = ["2025-10-01", "2025-11-06", "2025-11-07"]
    m = make_model(
        **BASE,
        payments=[(n, 1, money(100 * n), at(f"{d} 10:00:00"), "CASH") for n, d in enumerate(days, 1)],
        reservation_holds=[hold(n, 10, 100 + n) for n in (1, 2, 3)],
        tickets=[(n, n, n, money(1)) for n in (1, 2, 3)],
    )
    summary = load_fact(spark, m, path, "loaded_fact").first()
    assert (summary["total_fact_records"], summary["total_revenue"]) == (3, money(600))
    assert rows(read_fact(spark, path).select(*FACT_COLUMNS)) == rows(fact_bookings(m))
    assert spark.table("loaded_fact").count() == 3
    described = spark.sql("DESCRIBE EXTENDED loaded_fact total_revenue").collect()
    assert {r["info_name"]: r["info_value"] for r in described}["distinct_count"] == "3"

    recent = recent_revenue(spark, path, date(2025, 11, 20))
    assert rows(recent) == rows(reports.daily_revenue(fact_bookings(m), date(2025, 11, 20)))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [((year" in plan
    spark.sql("DROP TABLE loaded_fact")
