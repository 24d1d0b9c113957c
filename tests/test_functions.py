from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from marquee.functions import calendar as cal
from marquee.functions import documents as docs
from marquee.functions import hashing
from marquee.functions import numeric as num


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, kind, function):
    df = column(spark, values, kind).select("i", function(F.col("v")).alias("out"))
    return [r["out"] for r in df.orderBy("i").collect()]


def test_time_labels_differ_only_at_known_hours(spark):
    hours = spark.range(24).select(F.col("id").cast("int").alias("h"))
    labels = hours.select(
        "h", cal.time_of_day_etl("h").alias("a"), cal.time_of_day_fn("h").alias("b"), cal.slot4("h").alias("c")
    ).collect()
    assert [r["h"] for r in labels if not r["a"] == r["b"] == r["c"]] == [0, 1, 2, 3, 4, 5, 17, 21]
    by_hour = {r["h"]: tuple(r)[1:] for r in labels}
    assert by_hour[17] == ("Afternoon", "Evening", "Afternoon")
    assert by_hour[21] == ("Evening", "Night", "Evening")
    assert by_hour[3] == ("Late Night", "Night", "Night")


def test_sql_function_matches_the_column(spark):
    cal.register_sql_functions(spark)
    hours = [None, *range(24)]
    got = apply(spark, hours, "int", lambda v: F.call_function("get_time_of_day", v))
    assert got == apply(spark, hours, "int", cal.time_of_day_fn)
    assert got[0] == "Night"


def test_weekend_and_weeks(spark):
    days = [date(2025, 11, 7), date(2025, 11, 8), date(2025, 11, 9), date(2024, 12, 30), date(2021, 1, 3)]
    assert apply(spark, days, "date", cal.is_weekend) == [False, True, True, False, True]
    assert apply(spark, days, "date", cal.day_type)[:4] == ["Friday", "Weekend", "Weekend", "Weekday"]
    assert apply(spark, days, "date", F.weekofyear)[3:] == [1, 53]
    assert apply(spark, days, "date", F.year)[3:] == [2024, 2021]
    assert apply(spark, days[:1], "date", lambda d: cal.day_name(d, True)) == ["Friday   "]


def test_date_labels_and_spine(spark):
    day = [date(2025, 11, 7)]
    assert apply(spark, day, "date", cal.short_date) == ["Nov 7"]
    assert apply(spark, day, "date", cal.long_date) == ["November 7, 2025"]
    assert apply(spark, day, "date", cal.weekday_date) == ["Fri, Nov 7"]
    spine = apply(spark, [date(2024, 2, 26)], "date", cal.date_spine)[0]
    assert spine[0] == "2024-02-26" and spine[3] == "2024-02-29" and spine[6] == "2024-03-03"


def test_time_shifts(spark):
    ts = [datetime(2025, 11, 7, 13, 45)]
    plus = lambda unit, n: apply(spark, ts, "timestamp_ntz", lambda t: cal.shift(t, unit, n))[0]
    assert plus("HOUR", 1) == datetime(2025, 11, 7, 14, 45)
    assert plus("DAY", -30) == datetime(2025, 10, 8, 13, 45)
    slot = apply(spark, ts, "timestamp_ntz", lambda t: cal.at_time(t, F.lit(26), F.lit(5)))
    assert slot == [datetime(2025, 11, 8, 2, 5)]


def test_currency(spark):
    values = ["0", "999.5", "1000", "1234567.8915", "0.0005", None, "547.6190476"]
    got = apply(spark, values, "string", lambda v: num.fmt_currency(v.cast("decimal(20,7)")))
    assert got == ["₱0.00", "₱999.50", "₱1,000.00", "₱1,234,567.892", "₱0.001", "₱0.00", "₱547.619"]


def test_axis(spark):
    values = ["0", "500.00", "999.5", "1000", "1499", "1500", "999999", "1000000", "1250000"]
    got = apply(spark, values, "string", lambda v: num.fmt_axis(v.cast("decimal(20,2)")))
    assert got == ["₱0", "₱500", "₱999.5", "₱1k", "₱1k", "₱2k", "₱1000k", "₱1.0M", "₱1.3M"]


def test_parsing(spark):
    texts = ["12.50 PHP", "", None, "abc", " -3e2x", ".5", "7."]
    floats = apply(spark, texts, "string", num.parse_float)
    assert floats[:3] == [12.5, 0.0, 0.0] and math.isnan(floats[3]) and floats[4:] == [-300.0, 0.5, 7.0]
    ints = apply(spark, texts, "string", num.parse_int)
    assert ints == [12, 0, 0, None, -3, None, 7]


def test_percent_rounds_halves_up(spark):
    df = spark.createDataFrame([(1, 8, 12.5), (1, 2000, 0.1), (1, 3, 33.3), (0, 5, 0.0)], "p long, t long, e double")
    assert df.filter(num.percent_of("p", "t") != F.col("e")).count() == 0
    assert spark.range(1).select(num.percent_of(F.lit(0), F.lit(0))).first()[0] is None


def test_json_documents(spark):
    shows = ['[{"id":7,"time":"10:00"},{"id":9,"time":"12:00"}]', "[]"]
    assert apply(spark, shows, "string", docs.first_showtime_id) == [7, None]
    seats = [
        '[{"id":1,"row_code":"A","number":1,"status":"TAKEN"},{"id":2,"status":"available"}]',
        '[{"id":1,"status":"TAKEN"}]',
    ]
    assert apply(spark, seats, "string", docs.first_available_seat) == [2, None]


def test_seat_grid(spark):
    got = apply(spark, [1, 5, 6, 15, 16, 20], "int", num.seat_grid_column)
    assert got == [1, 5, 7, 16, 18, 22]


def test_hash_is_spread_and_repeatable(spark):
    df = spark.range(20000).select(hashing.uniform("id", F.lit(3)).alias("u"))
    lo, hi, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < lo < 0.001 and 0.999 < hi < 1 and mean == pytest.approx(0.5, abs=0.01)
    again = spark.range(20000).select(hashing.uniform("id", F.lit(3)).alias("u"))
    assert rows(df.limit(5)) == rows(again.limit(5))
