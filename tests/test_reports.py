from __future__ import annotations

from datetime import date, timedelta

from cinema import money
from frames import rows
from pyspark.sql import functions as F

from marquee.operators import dashboard, distributions, reports
from marquee.sources.schemas import FACT_BOOKINGS
from marquee.sources.seed_rows import seed_fact_rows

AS_OF = date(2025, 11, 18)


def test_empty_fact_gives_one_summary_row(spark):
    empty = spark.createDataFrame([], FACT_BOOKINGS)
    assert rows(reports.analytics_summary(empty)) == [(0, 0, None, None, None)]
    assert reports.daily_revenue(empty, AS_OF).count() == 0
    assert reports.etl_summary(empty).first()["total_fact_records"] == 0


def test_recent_days_are_inclusive_and_open_ended(spark):
    seed = seed_fact_rows(spark, AS_OF).limit(1)
    days = [AS_OF + timedelta(days=d) for d in (-31, -30, 0, 1)]
    fact = seed.drop("booking_date").crossJoin(spark.createDataFrame([(d,) for d in days], "booking_date date"))
    got = [r["booking_date"] for r in reports.daily_revenue(fact, AS_OF).collect()]
    assert got == days[:0:-1]


def test_unknown_label_sorts_first(spark):
    fact = seed_fact_rows(spark, AS_OF)
    extra = fact.limit(1).withColumn("time_of_day", F.lit("Brunch"))
    order = [r["time_of_day"] for r in dashboard.time_of_day_ordered(fact.unionByName(extra)).collect()]
    assert order == ["Brunch", "Morning", "Afternoon", "Evening", "Night"]


def test_shared_titles_merge(spark):
    fact = seed_fact_rows(spark, AS_OF).withColumn("movie_title", F.lit("Same"))
    row = reports.top_movies(fact).collect()
    assert len(row) == 1 and row[0]["total_revenue"] == money(11500)


def test_shares_and_repeat_rate(spark):
    sizes = [(1, 1), (2, 1), (3, 2), (3, 2), (4, 3), (4, 3), (4, 3)]
    tickets = spark.createDataFrame([(p,) for p, _ in sizes], "payment_id long")
    assert rows(distributions.seats_per_booking(tickets)) == [(1, 2, 50.0), (2, 1, 25.0), (3, 1, 25.0)]
    payments = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "customer_id long")
    assert rows(distributions.repeat_rate(payments)) == [(2, 1, 50.0)]
    assert rows(distributions.repeat_rate(payments.limit(0))) == [(0, 0, None)]
