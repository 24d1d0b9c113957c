"""How the booking model is read from the trade tables."""

from __future__ import annotations

import re
from datetime import datetime

import pytest

from marquee import queries
from marquee.plans import fact
from marquee.sources.schemas import TRADE
from marquee.sources.trade_tables import TradeTables

DAY = datetime(1996, 5, 3)
ROWS = {
    "customer": [{"c_custkey": n, "c_name": f"c{n}"} for n in range(3)],
    "supplier": [{"s_suppkey": n} for n in range(2)],
    "part": [{"p_partkey": n, "p_name": f"p{n}", "p_size": n, "p_retailprice": 9.0} for n in range(20)],
    "orders": [
        {"o_orderkey": n, "o_custkey": n % 3, "o_totalprice": 10.0 + n, "o_orderdate": DAY.replace(year=1996 + n % 2)}
        for n in range(40)
    ],
    "lineitem": [
        {"l_orderkey": n, "l_linenumber": i + 1, "l_partkey": (n + i) % 20, "l_extendedprice": 5.0}
        for n in range(40)
        for i in range(3)
    ],
}


@pytest.fixture
def tables(spark, tmp_path):
    for name, rows in ROWS.items():
        names = TRADE[name].fieldNames()
        rows = [tuple(row.get(c) for c in names) for row in rows]
        spark.createDataFrame(rows, TRADE[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield TradeTables(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_holds_and_tickets_share_the_shuffle_of_lines(tables):
    booked = fact.fact_bookings(tables.booking_model())
    plan = booked._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1 and "ReusedExchange [l_orderkey" in plan
    assert sum(r["seats_booked"] for r in booked.collect()) == 120


def test_refreshed_reports_build_the_fact_once(tables, monkeypatch):
    """Both versions are published from the stored fact, not from the tables again."""
    read, publish = [], queries.publish
    monkeypatch.setattr(queries, "publish", lambda df, path: read.append(df.inputFiles()) or publish(df, path))
    refreshed = queries._refreshed(tables)
    assert len(read) == 2 and not any("lineitem" in name for names in read for name in names)
    assert refreshed.analytics_summary().first()["total_seats_sold"] == 120


def test_no_array_of_lines_is_shuffled_for_requests(tables, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = tables.booking_requests()
        plan = requests._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    (first,) = [i for i, line in enumerate(lines) if "functions=[collect_list" in line]
    assert not any("Exchange" in line for line in lines[:first])
    assert sorted((r["request_id"], len(r["seats"]), r["customer_name"]) for r in requests.collect()) == [
        (n, 3, f"c{n % 3}") for n in range(40)
    ]
